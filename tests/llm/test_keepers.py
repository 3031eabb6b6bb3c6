"""The near-duplicate stage keeps rows, not ids."""

from pairwell.llm import simhash

X, Y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))


def test_other_texts_under_a_kept_id_stay(make_docs):
    rows = [(5, X), (5, Y), (5, X), (7, X + " more"), (8, Y), (None, X), (None, X), (9, None), (9, ""), (10, "alone here")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(make_docs(rows)).collect()), key=str)
    assert [k for k in kept if k[0] == 5] == [(5, X), (5, Y)]
    assert [k[0] for k in kept if k[0] in (7, 8)] == [] and kept.count((None, X)) == 2 and (10, "alone here") in kept
    assert sum(k[0] == 9 for k in kept) == 1
