import pytest

from pairwell.operators import literals

TEXTS = [
    (1, "some text CANARY-ab12 more"), (2, '"Canary-AB12."'), (3, "ca​nary-﻿ab12"), (4, "nothing here"), (5, None), (6, ""), (7, "die STRASSE ist lang"),
    (8, "éclair and Éclair"), (9, "canary-ab1 2"), (4, "nothing here"), (10, "one two three four five six seven eight nine ten"),
]
CANARIES = [
    ("a", "CANARY-ab12"), ("same", "canary-AB12"), ("blank", "  "), ("empty", ""), ("null", None), ("sign", "​"), ("street", "straße"), ("cake", "éclair"),
    ("letter", "h"), ("long", "Two three four five six seven eight nine ten"), ("part", "ary-ab"),
]


def brute():
    out = []
    for i, text in TEXTS:
        for c, canary in CANARIES:
            if text and canary and literals.fold(canary).strip() and literals.fold(canary) in literals.fold(text):
                out.append((i, c))
    return sorted(out)


@pytest.mark.parametrize("most", [4 << 20, 40])
def test_hits_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(literals, "MOST_CHARS", most)
    texts = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "id long, body string, text string")
    canaries = spark.createDataFrame(CANARIES, "name string, canary string")
    got = sorted(map(tuple, literals.literal_hits(texts, canaries, "id", "name", "body", "canary").collect()))
    assert got == brute()
    assert {(1, "a"), (2, "a"), (3, "a"), (7, "street"), (8, "cake"), (10, "long")} <= set(got)
    assert not {c for _, c in got} & {"blank", "empty", "null", "sign"}


def test_no_texts_and_no_literals(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    canaries = spark.createDataFrame(CANARIES, "name string, text string")
    assert literals.literal_hits(texts.limit(0), canaries, "id", "name").count() == 0
    assert literals.literal_hits(texts, canaries.limit(0), "id", "name").count() == 0
