import random

import numpy as np

from pairwell.llm import simhash
from test_simhash import groups


def shingles(text, words=5):
    tokens = (text or "").lower().split()
    k = min(words, len(tokens))
    return frozenset(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)) if tokens else frozenset()


def jaccard_at_least(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([4, 9, 40, 120, 300]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy[rng.choice([0, 0, 1, 8]) :]))
    notice = " ".join(rng.choices(vocabulary, k=30))  # a passage that many texts share
    rows += [notice + " " + " ".join(rng.choices(vocabulary, k=rng.choice([2, 6, 60]))) for _ in range(12)]
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)] + [(None, rows[0]), (2000, ""), (2001, None), (2002, rows[3].upper())]


def test_components_are_all_pairs_of_similar_sets(make_docs):
    rows = corpus(random.Random(11))
    sets = [shingles(t) for _, t in rows]
    root = groups(list(range(len(rows))), lambda a, b: jaccard_at_least(sets[a], sets[b]))
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[root[k]] = min(i, first.get(root[k], i))
    want = [(i, first.get(root[k])) for k, (i, _) in enumerate(rows)]
    got = [tuple(r) for r in simhash.similar_groups(make_docs(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_copies_with_edited_words_go(make_docs):
    rng = random.Random(12)
    base = rng.choices([f"w{i}" for i in range(500)], k=200)
    edited = list(base)
    for at in (20, 90, 160):
        edited[at] = "other"
    kept = simhash.keep_one(make_docs([(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(reversed(base)))]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_similar_sets_share_a_first_shingle():
    rng = np.random.default_rng(3)
    for _ in range(500):
        n = int(rng.integers(1, 60))
        common = np.unique(rng.integers(0, 2**63, n, np.uint64))
        a = np.union1d(common, rng.integers(0, 2**63, rng.integers(0, n // 8 + 1), np.uint64))
        b = np.union1d(common, rng.integers(0, 2**63, rng.integers(0, n // 8 + 1), np.uint64))
        often = np.sort(rng.choice(common, len(common) // 3, replace=False))
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            assert len(np.intersect1d(simhash.prefix(a, often), simhash.prefix(b, often)))


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 200, 5000):
        a, b = (np.unique(rng.integers(0, 2**64, n, np.uint64)) for _ in range(2))
        b = np.union1d(a[: n // 2], b[n // 2 :])
        differ = np.bitwise_count(simhash.parity_sketch(a) ^ simhash.parity_sketch(b)).sum()
        assert differ <= len(np.setxor1d(a, b)) and not (simhash.parity_sketch(a) ^ simhash.parity_sketch(a)).any()


def test_a_group_of_near_copies_whose_middle_is_anywhere(make_docs):
    rng = random.Random(13)
    base = rng.choices([f"w{i}" for i in range(3000)], k=150)
    rows = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(150), 3):
            copy[at] = f"edit{i}-{at}"
        rows.append((i, " ".join(base if i == 41 else copy)))
    sets = [shingles(t) for _, t in rows]
    root = groups(list(range(60)), lambda a, b: jaccard_at_least(sets[a], sets[b]))
    got = dict(tuple(r) for r in simhash.similar_groups(make_docs(rows)).collect())
    assert got == {i: root[i] for i, _ in rows}
