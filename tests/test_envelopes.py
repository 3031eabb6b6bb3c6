"""A provider's JSON envelope, member by member."""

import json

import pytest

from pairwell.operators import provider_envelopes

TOKENS = {"input": 3, "prompt": 5, "candidates": 2, "total": 9, "cached": 2, "thoughts": 0, "tool": 0}
GOOD = {"session_id": "s", "response": "hi", "stats": {"models": {"a": {"tokens": TOKENS}, "b": {"tokens": TOKENS}}, "tools": {"totalCalls": 4}}}


def model(**change):
    return {"stats": {"models": {"a": {"tokens": TOKENS | change}}}}


CASES = [
    (GOOD, "complete", None), (GOOD | {"stats": None}, "complete", None), (GOOD | {"stats": {"models": {}}}, "complete", None),
    ("{", "protocol_invalid", "malformed JSON"), ('{"response": 1e999}', "protocol_invalid", "malformed JSON"), ("[]", "protocol_invalid", "output must be an object"),
    (GOOD | {"session_id": 1}, "protocol_invalid", "session_id must be a non-empty string"), (GOOD | {"session_id": " "}, "protocol_invalid", "session_id must be a non-empty string"),
    (GOOD | {"error": {"type": "E", "message": "m"}, "response": None}, "provider_error", "E: m"), (GOOD | {"error": "x"}, "protocol_invalid", "error must be an object"),
    (GOOD | {"error": {"type": "E"}}, "protocol_invalid", "error.message must be a non-empty string"), (GOOD | {"warnings": "x"}, "protocol_invalid", "warnings must be an array"),
    (GOOD | {"warnings": None}, "protocol_invalid", "warnings must be an array"), (GOOD | {"warnings": ["a", 1]}, "protocol_invalid", "warning must be a non-empty string"),
    (GOOD | {"warnings": ["a", "Loop detected, stopping execution"]}, "provider_error", "Loop detected, stopping execution"),
    (GOOD | {"warnings": ["AGENT EXECUTION STOPPED: x"], "response": None}, "provider_error", "AGENT EXECUTION STOPPED: x"), (GOOD | {"warnings": ["loop detected"]}, "complete", None),
    (GOOD | {"response": ""}, "protocol_invalid", "response must be a non-empty string"), (GOOD | {"response": 1}, "protocol_invalid", "response must be a non-empty string"),
    (GOOD | {"response": 1, "error": {"type": "E", "message": "m"}}, "protocol_invalid", "response must be a string when present"),
    (GOOD | {"stats": []}, "protocol_invalid", "stats must be an object"), (GOOD | {"stats": {}}, "protocol_invalid", "stats.models must be an object"),
    (GOOD | model(total=True), "protocol_invalid", "tokens.total must be a non-negative integer"), (GOOD | model(tool=-1), "protocol_invalid", "tokens.tool must be a non-negative integer"),
    (GOOD | model(cached=1), "protocol_invalid", "prompt must equal input + cached"), (GOOD | model(total=6), "protocol_invalid", "total cannot be less than prompt + candidates"),
    (GOOD | {"stats": {"models": {"a": 1}}}, "protocol_invalid", "a model must be an object"), (GOOD | {"stats": {"models": {"a": {}}}}, "protocol_invalid", "tokens must be an object"),
    (GOOD | {"stats": {"models": {}, "tools": {"totalCalls": "4"}}}, "protocol_invalid", "stats.tools.totalCalls must be a non-negative integer"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, c[0] if isinstance(c[0], str) else json.dumps(c[0])) for i, c in enumerate(CASES)]
    return {r.i: r for r in provider_envelopes.envelope_outcomes(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()}


def test_every_case(found):
    assert {i: (found[i].status, found[i].reason) for i in range(len(CASES))} == {i: c[1:] for i, c in enumerate(CASES)}


def test_usage_is_summed_over_models(found):
    r = found[0]
    assert (r.models, r.input_tokens, r.output_tokens, r.total_tokens, r.cache_read_tokens, r.tool_calls, r.response) == ("a,b", 10, 4, 18, 4, 4, "hi")
    assert (found[1].models, found[1].total_tokens, found[1].tool_calls) == (None, None, None)
