"""Text predicates as column expressions, on the rendered view of a text."""

from __future__ import annotations

import difflib
import json
import math
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions.view import fold_of, folded, rendered

@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def casefold(texts: pd.Series) -> pd.Series:
    """Exact case folding of the composed rendered view."""
    return texts.map(lambda t: None if t is None else fold_of(t))


def contains(text: Column, value: Column) -> Column:
    """TXT1."""
    return F.contains(folded(text), folded(value))


def _has(text: Column, value: str) -> Column:
    return F.contains(folded(text), F.lit(fold_of(value)))


def contains_any(text: Column, values: list[str]) -> Column:
    """TXT2."""
    return reduce(lambda a, b: a | b, (_has(text, v) for v in values), F.lit(False))


def missing(text: Column, values: list[str]) -> Column:
    """TXT3's evidence: the values that are not in the text."""
    return F.array_compact(F.array(*(F.when(~_has(text, v), v) for v in values)))


def contains_all(text: Column, values: list[str]) -> Column:
    """TXT3."""
    return reduce(lambda a, b: a & b, (_has(text, v) for v in values), F.lit(True))


def excludes_any(text: Column, values: list[str]) -> Column:
    """TXT4."""
    return ~contains_any(text, values)


def matches(text: Column, pattern: str) -> Column:
    """TXT5 for vetted patterns; see `bounded_regex` for others."""
    return F.rlike(rendered(text), F.lit(f"(?i){pattern}"))


def bounded_regex(pattern: str, seconds: float = 0.25):
    """TXT5 for any pattern: a column function whose result is null where the time runs out."""

    @F.pandas_udf("boolean")
    def search(texts: pd.Series) -> pd.Series:
        import regex

        compiled = regex.compile(pattern, regex.IGNORECASE)

        def one(text: str | None) -> bool | None:
            try:
                return None if text is None else compiled.search(text, timeout=seconds) is not None
            except TimeoutError:
                return None

        return texts.map(one).astype("object")

    return search


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """TXT6: matching-blocks ratio, rounded to 4 places before any threshold."""
    return pd.Series(
        [None if a is None or b is None else round(difflib.SequenceMatcher(None, a, b).ratio(), 4) for a, b in zip(left, right)], dtype="float64"
    )


def cosine(a: Column, b: Column) -> Column:
    """TXT7: zero vectors and negative cosines give 0; rounded to 4 places."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), dot(a, b) / norm), 4))


def removed(text: Column, sign: str) -> Column:
    """TXT8: how many of a zero-width sign the rendered view drops."""
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def golden(text: Column, expected: Column, mode: str) -> Column:
    """TXT9: exact, trim or text (white-space runs as one space, ends trimmed: our choice)."""
    if mode == "exact":
        return text == expected
    if mode == "trim":
        return F.btrim(text) == F.btrim(expected)
    tidy = lambda t: F.btrim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
    return tidy(text) == tidy(expected)


def json_field_equals(document: Column, path: str, expected: str) -> Column:
    """TXT10: a missing document or field fails."""
    return F.coalesce(F.get_json_object(document, path) == expected, F.lit(False))


def _schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    found, want = [], schema.get("type")
    if want in ("number", "integer"):
        number = isinstance(value, int | float) and not isinstance(value, bool)
        if not number or (want == "integer" and value != int(value)):
            return [f"{at}: not {want}"]
    elif want and not isinstance(value, kinds[want]):
        return [f"{at}: not {want}"]
    typed = lambda x: json.dumps(x, sort_keys=True, allow_nan=False)
    same = lambda a, b: typed(a) == typed(b)
    if "const" in schema and not same(value, schema["const"]):
        found.append(f"{at}: not the constant")
    if "enum" in schema and not any(same(value, e) for e in schema["enum"]):
        found.append(f"{at}: not in enum")
    if isinstance(value, dict):
        found += [f"{at}: {k} is missing" for k in schema.get("required", ()) if k not in value]
        for k, s in schema.get("properties", {}).items():
            if k in value:
                found += _schema_errors(value[k], s, f"{at}.{k}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            found.append(f"{at}: wrong number of items")
        for i, x in enumerate(value):
            found += _schema_errors(x, schema.get("items", {}), f"{at}[{i}]")
    return found


def structured_output(schema: dict):
    """TXT11: a column function from a JSON text to its schema errors; text that is no strict JSON has one error."""

    @F.pandas_udf("array<string>")
    def errors(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            value, why = parse_strict(text)
            return [why] if why else _schema_errors(value, schema)

        return texts.map(one)

    return errors


def parse_strict(text: str | None, depth: int = 100):
    """SRC6: (value, None) or (None, reason): no repeated keys, no NaN or infinity, bounded depth, no lone surrogates."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    def constant(name):
        raise ValueError(f"not a JSON number: {name}")

    def deep(value, left):
        if isinstance(value, float) and not math.isfinite(value):
            raise ValueError("number out of range")
        if not isinstance(value, dict | list):
            return
        if left == 0:
            raise ValueError("too deep")
        for x in value.values() if isinstance(value, dict) else value:
            deep(x, left - 1)

    try:
        value = json.loads(text or "", object_pairs_hook=pairs, parse_constant=constant)
        deep(value, depth)
        json.dumps(value, ensure_ascii=False, allow_nan=False).encode()
        return value, None
    except RecursionError:
        return None, "too deep"
    except UnicodeEncodeError:
        return None, "lone surrogate"
    except ValueError as e:
        return None, str(e)


@F.pandas_udf(T.StructType().add("ok", T.BooleanType()).add("error", T.StringType()))
def strict_json(texts: pd.Series) -> pd.DataFrame:
    reasons = [parse_strict(t)[1] for t in texts]
    return pd.DataFrame({"ok": [r is None for r in reasons], "error": reasons})


def redact(text: Column, secrets: list[str]) -> Column:
    """FLT9: every secret, longest first, becomes [REDACTED]."""
    for s in sorted(filter(None, secrets), key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    return text


def redact_json(text: Column, secrets: list[str]) -> Column:
    """FLT9: secrets inside the strings and keys of a JSON text, at every depth; numbers and structure stay.

    The text is brought to canonical escapes first, so no escape hides a secret, and secrets are escaped the same way.
    What is no JSON is redacted as plain text. Keys that a redaction makes equal are all kept.
    """
    value = F.try_parse_json(text)
    parts = F.regexp_extract_all(F.to_json(value), F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++'), F.lit(0))
    escaped = [json.dumps(s, ensure_ascii=False)[1:-1] for s in secrets]
    done = F.array_join(F.transform(parts, lambda x: F.when(F.startswith(x, F.lit('"')), redact(x, escaped)).otherwise(x)), "")
    return F.when(value.isNull(), redact(text, secrets)).otherwise(done)


def script_score(stdout: Column) -> Column:
    """TXT13: score / max_score of a recorded score line; null if it has none or is out of range."""
    score, most = (F.get_json_object(stdout, f"$.{k}").try_cast("double") for k in ("score", "max_score"))
    return F.when((most > 0) & (score >= 0) & (score <= most), F.round(score / most, 4))
