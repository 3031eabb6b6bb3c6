import random

import numpy as np

from pairwell.llm import pieces
from test_pieces import OWN, ids


def word_forms(raw):
    """The ids of each word: a word begins at a piece with a space."""
    out = []
    for i in ids(raw):
        if OWN.raw[i].startswith(b" "):
            out.append([])
        out[-1].append(i)
    return [tuple(w) for w in out]


def test_every_occurrence_draws():
    word = "misunderstanding"
    forms = word_forms(OWN.encode(" ".join([word] * 2000), 1, 0.1, 7))
    plain = word_forms(OWN.encode(word, 1, 0.0, 7))[0]
    assert len(forms) == 2000 and len(set(forms)) > 4  # four in all, whatever the count, if drawn once a variant
    rng, below = random.Random(5), int(0.1 * 2**64)  # a skip may lead to the plain ids by other merges, so the share is drawn too
    free = np.mean([tuple(OWN.segment(pieces.SPACE + word, rng.getrandbits(64), below)) == plain for _ in range(2000)])
    assert abs(np.mean([f == plain for f in forms]) - free) < 5 * (free * (1 - free) / 1000) ** 0.5


def test_remembered_words_equal_whole_segmentation(monkeypatch):
    text = "international organisation of misunderstanding " * 50
    one = OWN.encode(text, 3, 0.2, 7)
    monkeypatch.setattr(pieces, "CACHE_CHARS", 0)
    assert one == OWN.encode(text, 3, 0.2, 7)
