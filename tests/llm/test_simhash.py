import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pairwell.llm import simhash


def brute_fingerprint(text, words=4):
    tokens = []
    word = b""
    for byte in (text or "").encode():
        byte = byte + 32 if 65 <= byte <= 90 else byte
        if byte == 0x20 or 9 <= byte <= 13:
            tokens, word = tokens + ([word] if word else []), b""
        else:
            word += bytes([byte])
    tokens += [word] if word else []
    if not tokens:
        return 0
    k = min(words, len(tokens))
    hashes = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + k]), 42) for i in range(len(tokens) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and near(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def near(a, b):
    return bin(a ^ b).count("1") <= 4


def flip(rng, fp, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << b
    return fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_ways():
    assert [w for _, w in simhash.segment_sets(5)[:5]] == [(0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 4)]
    assert len(simhash.segment_sets(5)) == 40 and len(simhash.segment_sets(7)) == 112


def test_every_near_pair_has_a_key():
    rng = random.Random(5)
    for length in (5, 7):
        sets = simhash.segment_sets(length)
        for _ in range(3000):
            a = rng.getrandbits(64)
            b = flip(rng, a, 4)
            diff = np.array([a ^ b], np.uint64)
            ok = [
                start
                for start, segments in sets
                if all((a ^ b) >> 8 * s & 255 == 0 for s in segments) and len(simhash.within_chain(diff, start))
            ]
            assert ok


def test_chain_is_full_check():
    rng = random.Random(6)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = flip(rng, a, 7)
        if any(len(simhash.within_chain(np.array([a ^ b], np.uint64), i)) for i in range(8)):
            assert near(a, b)


def test_components_of_clusters(spark, monkeypatch):
    rng = random.Random(7)
    values = {0, 2**64 - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        values |= {flip(rng, centre, 6) for _ in range(rng.choice([1, 3, 20, 60]))}
    want = groups(sorted(values), near)
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for dense in (20_000, 10, 2):
        monkeypatch.setattr(simhash, "DENSE", dense)
        edges = simhash.links(nodes).collect()
        assert all(near(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in edges)
        linked = {frozenset((r.u & (2**64 - 1), r.v & (2**64 - 1))) for r in edges}
        assert groups(sorted(values), lambda a, b: frozenset((a, b)) in linked) == want


def test_documents_against_brute_force(make_docs, odd_rows):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    text = " ".join(rng.choices(words, k=400))
    rows = odd_rows + [(100 + i, text if i % 3 else text.replace(rng.choice(words), "other", 1)) for i in range(20)]
    rows += [(200 + i, " ".join(rng.choices(words, k=30))) for i in range(20)]
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    root = groups(sorted({f for _, f in fps}), near)
    first = {}
    for i, f in fps:
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    got = simhash.near_duplicates(make_docs(rows)).select("doc_id", F.lower(F.hex("fp")), "component_id").collect()
    want = [(i, f"{f:x}", first.get(root[f])) for i, f in fps]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_long_chain_component(spark):
    from pairwell.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 50)], "u long, v long")
    got = {(r.node, r.label) for r in connected_components(edges).collect()}
    assert got == {(i, 0) for i in range(201)} | {(500 + i, 500) for i in range(50)}


def test_crowded_keys_are_searched_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    low = [rng.getrandbits(32) for _ in range(20)]
    values = {(0xABCD1234 << 32) | v ^ sum(1 << b for b in rng.sample(range(32), k)) for v in low for k in range(5)}
    want = groups(sorted(values), near)
    monkeypatch.setattr(simhash, "DENSE", 3)
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    blocks = simhash._in_blocks(simhash._keyed(nodes, 7)).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert blocks < len(values)  # no key holds them all
    linked = {frozenset((r.u & (2**64 - 1), r.v & (2**64 - 1))) for r in simhash.links(nodes).collect()}
    assert all(near(*pair) for pair in linked)
    assert groups(sorted(values), lambda a, b: frozenset((a, b)) in linked) == want
