import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwell.llm import pieces
from pairwell.llm.tokens import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = pieces.Pieces(PATH)
CHARS = st.one_of(st.sampled_from("  \n\t aeionrstlé漢🙂\u0000"), st.characters(codec="utf-8"))


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(CHARS, max_size=80).filter(lambda t: pieces.SPACE not in t and "\u0000" not in t))
def test_rate_zero_is_the_library(text):
    assert ids(OWN.encode(text, 1, 0.0, 7)) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(CHARS | st.just(pieces.SPACE), max_size=80), st.integers(0, 99), st.sampled_from([0.0, 0.1, 0.7, 1.0]))
def test_lossless(text, key, rate):
    assert OWN.decode(OWN.encode(text, key, rate, 7)) == text


def test_seeded_and_varied():
    text = "international organisation of understanding " * 40
    one = OWN.encode(text, 1, 0.3, 7)
    assert one == pieces.Pieces(PATH).encode(text, 1, 0.3, 7)
    assert one != OWN.encode(text, 2, 0.3, 7) and one != OWN.encode(text, 1, 0.3, 8)
    assert len(ids(OWN.encode(text, 1, 1.0, 7))) > len(ids(one)) > len(ids(OWN.encode(text, 1, 0.0, 7)))


def test_documents(make_docs, odd_rows):
    coded = pieces.encode(make_docs(odd_rows), PATH)
    back = pieces.decode(coded, PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in odd_rows), key=str)
    want = {(i, OWN.encode(t, -1 if i is None else i, pieces.DROPOUT, pieces.SEED)) for i, t in odd_rows}
    assert {(r.doc_id, bytes(r.ids)) for r in back} == want
    assert pieces.encode(make_docs([]), PATH).count() == 0


def naive(chunk, salt, below):
    """The agenda as a search for the best pair that was not skipped, over and over."""
    parts, at, skipped = list(chunk), list(range(len(chunk))), set()
    while True:
        pairs = [(OWN.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in OWN.rank and (at[i], a + b) not in skipped]
        if not pairs:
            break
        (_, piece), i = min(pairs, key=lambda p: (p[0][0], p[1]))
        merged = parts[i] + parts[i + 1]
        x = salt ^ pieces.merge_name(at[i], piece)
        for shift, odd in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
            x = (x ^ x >> shift) * odd % 2**64
        if x < below:
            skipped.add((at[i], merged))
        else:
            parts[i : i + 2], at[i : i + 2] = [merged], [at[i]]
    return [i for p in parts for i in ([OWN.rank[p][1]] if p in OWN.rank else OWN.bytes_of(p))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["understanding", "misinternational", "aaaaaaa", "straße", "a", "漢字x", "the"]), max_size=30), st.sampled_from([0.1, 0.5, 0.9]), st.integers(0, 9))
def test_dropout_is_the_naive_agenda(words, rate, key):
    text, below = " ".join(words), int(rate * 2**64)
    OWN.noted = {pieces.SPACE + w: pieces.REMEMBER_AT for w in words[::2]}
    salts = pieces.occurrence_salts(key, 7, len(words)).tolist()
    want = [i for w, salt in zip(words, salts) for i in naive(pieces.SPACE + w, salt, below)]
    assert ids(OWN.encode(text, key, rate, 7)) == want


def test_a_full_memory_changes_nothing(monkeypatch):
    rows = [(k, f"international word{k} understanding " * 9) for k in range(30)]
    want = OWN.encode_batch(rows, 0.2, 7)
    monkeypatch.setattr(pieces, "CACHE", 3)
    monkeypatch.setattr(pieces, "REMEMBER_AT", 1)
    monkeypatch.setattr(pieces, "PAIRS", 2)
    assert pieces.Pieces(PATH).encode_batch(rows, 0.2, 7) == want
