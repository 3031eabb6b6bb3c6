import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwell.llm import simple8b

IDS = st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(IDS, max_size=140), max_size=6))
def test_round_trip(docs):
    counts = np.array([len(d) for d in docs], np.int64)
    ids = np.array([i for d in docs for i in d], np.uint64)
    words, per = simple8b.encode(ids, counts)
    assert len(words) == per.sum()
    assert simple8b.decode(words, per, counts).tolist() == ids.tolist()
    at = 0
    for d, n in zip(docs, per.tolist()):  # each document by itself
        assert simple8b.decode(words[at : at + n], [n], [len(d)]).tolist() == d
        at += n


def test_small_ids_are_packed():
    words, _ = simple8b.encode(np.ones(600, np.uint64), [600])
    assert len(words) == 10
