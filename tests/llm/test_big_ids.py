import hashlib
import random

from pairwell.llm import fingerprints
from pairwell.llm.ordering import id_ranges


def corpus():
    rng = random.Random(1)
    ids = [2**62 + i for i in range(300)] + [2**53 + i for i in range(-3, 4)] + [-(2**63), 2**63 - 1, -(2**62) - 1, -(2**62), -5, 0]
    rows = [(i, f"text {i} " + "word " * rng.randrange(30)) for i in ids]
    rng.shuffle(rows)
    return rows


def test_neighbours_of_ids_that_doubles_cannot_tell(make_docs):
    rows = corpus()
    ordered, want = sorted(rows), {}
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 4
        want[i] = hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.canonical_fingerprints(make_docs(rows)).collect()}
    assert got == want


def test_heads_are_the_least_ids_of_their_parts(make_docs):
    docs = make_docs(corpus())
    for parts in (1, 2, 4, 50):
        ranges = id_ranges(docs, "doc_id", parts)
        least = {}
        for r in ranges.part(docs, "doc_id", "part").collect():
            least[r.part] = min(r.doc_id, least.get(r.part, r.doc_id))
        assert [least[k] for k in sorted(least)] == list(ranges.heads)
        assert sorted(least) == list(range(1, len(ranges.heads) + 1))


def test_equal_texts_of_a_collision_have_equal_fingerprints(make_docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda canon: "same")
    got = fingerprints.canonical_fingerprints(make_docs([(1, "a b"), (2, "c d"), (3, "A  b"), (4, "x")])).collect()
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[1] == by[3] and len({by[1], by[2], by[4]}) == 3
    assert all(r.edited_fingerprint == r.fingerprint for r in got if r.near_edited == 1)
