import hashlib

import xxhash
import zstandard

from pairwell.llm import fingerprints
from pairwell.llm.fingerprints import canonical, canonical_fingerprints, digest, edited_text, verified


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh3_64_intdigest((r[1] or "").encode())))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        edited = edited_text(text, following)
        out.append(
            (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(canonical(text)), digest(canonical(edited)),
             float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(following)))
        )
    return sorted(out, key=str)


def test_against_brute_force(spark, make_docs, odd_rows):
    got = canonical_fingerprints(make_docs(odd_rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(odd_rows)


def test_many_parts(spark, make_docs):
    rows = [(i * 3 % 101, f"text {i % 7} " * (i % 13)) for i in range(101)]
    assert sorted(map(tuple, canonical_fingerprints(make_docs(rows)).collect()), key=str) == brute(rows)


def test_empty_and_single(make_docs):
    assert canonical_fingerprints(make_docs([])).count() == 0
    assert sorted(map(tuple, canonical_fingerprints(make_docs([(1, "abcdefgh")])).collect())) == brute([(1, "abcdefgh")])


def test_canonical_folds():
    assert canonical("Ａ  b C\n") == canonical("a B c") == b"a b c"
    assert canonical("Straße") == canonical("STRASSE")


def test_a_colliding_hash_is_split(spark):
    rows = spark.createDataFrame(
        [(1, 1, "e", "h", "h2", 0.0, 0.0, zstandard.compress(b"a")), (2, 1, "e", "h", "h2", 0.0, 0.0, zstandard.compress(b"b"))], fingerprints.FINGERPRINTED
    )
    assert len({r.fingerprint for r in verified(rows).collect()}) == 2
