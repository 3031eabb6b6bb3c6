import zlib
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairwell.llm import packing, token_files
from pairwell.llm.tokens import ByteEncoder, WordEncoder, tokenizer_path

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
CHARS = st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x1f\x85  '’.,!$0123aéßÉİΣſ́漢🙂"), st.characters(codec="utf-8"))


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


KINDS = [(ByteEncoder(BYTES), plain(BYTES)), (WordEncoder(WORDS), plain(WORDS))]


@pytest.mark.parametrize("kind", [0, 1])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(CHARS, max_size=60), max_size=4))
def test_equals_whole_text_calls(kind, texts):
    ours, whole = KINDS[kind]
    assert ours.encode_batch(texts) == [whole(t) for t in texts]


@pytest.mark.parametrize("kind", [0, 1])
def test_phrases(kind):
    ours, whole = KINDS[kind]
    for text in ("It's we'll DON'T  a\n\n  b \n", "<|endoftext|> x<|startoftext|>", "a\n b", "  lead", "trail  ", "İstanbul ΟΔΟΣ ", "a\x1c!\x1d b"):
        assert ours.encode_batch([text]) == [whole(text)]


def brute_starts(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(KINDS[1][1](r[1] or ""))))
    out, start = [], 0
    for doc_id, text in order:
        ids = KINDS[1][1](text or "") + array("I", [2]).tobytes()
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return sorted(out, key=str)


def read_back(spark, docs, path):
    token_files.write_token_files(docs, path, WORDS)
    rows = token_files.with_starts(token_files.read_token_files(spark, path, with_ids=True))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", "ids").collect()


def test_files_against_brute_force(spark, make_docs, odd_rows, tmp_path):
    got = read_back(spark, make_docs(odd_rows), f"file://{tmp_path}/t")
    assert sorted(map(lambda r: tuple(r)[:4], got), key=str) == brute_starts(odd_rows)
    for r in got:
        assert zlib.crc32(array("I", r.ids).tobytes()) == r.ids_crc32


def test_files_many_blocks(spark, make_docs, tmp_path, monkeypatch):
    rows = [(i * 7 % 211, f"word{i} and {i} more " * (i % 17)) for i in range(211)]
    monkeypatch.setattr(token_files, "BLOCKS_PER_FILE", 2)
    got = read_back(spark, make_docs(rows), f"file://{tmp_path}/t")
    assert sorted(map(lambda r: tuple(r)[:4], got), key=str) == brute_starts(rows)


def test_files_of_an_empty_table(spark, make_docs, tmp_path):
    assert read_back(spark, make_docs([]), f"file://{tmp_path}/t") == []


def test_pieces():
    assert packing.piece_lengths(1) == [1]
    assert packing.piece_lengths(2048 + 5) == [1024, 1024, 4, 1]


def test_packing_against_brute_force(make_docs, odd_rows):
    got = packing.pack(make_docs(odd_rows), BYTES, with_ids=True).collect()
    want = []
    for doc_id, text in odd_rows:
        ids = KINDS[0][1](text or "") + array("I", [0]).tobytes()
        at = 0
        for n in packing.piece_lengths(len(ids) // 4):
            piece = ids[4 * at : 4 * (at + n)]
            want.append((doc_id, at, n, zlib.crc32(piece), len(ids) // 4, piece))
            at += n
    assert sorted([tuple(r)[:5] + (bytes(r.ids),) for r in got], key=str) == sorted(want, key=str)
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    ordered = sorted(got, key=lambda r: r.sequence_id)
    keys = [(-r.length, r.doc_id is not None, r.doc_id or 0, r.start) for r in ordered]
    assert keys == sorted(keys) and {r.offset for r in got} == {0}


def test_packing_empty(make_docs):
    assert packing.pack(make_docs([]), BYTES).count() == 0


def test_a_new_word_is_encoded_once_when_it_is_met():
    """No second pass over a batch's words: a full cache of words answers without one, and a cut cache stays right."""
    from pairwell.llm import tokens

    texts = ["one two  two\tthree\x1cfour", "İstanbul two é 漢字 one", "", "x y 'll don't 12"]
    for kind, name in ((tokens.WordEncoder, "word_bpe_49k.json"), (tokens.ByteEncoder, "byte_bpe_50k.json")):
        enc = kind(tokens.tokenizer_path(name))
        met = []
        new = enc.words.new
        enc.words.new = lambda w: met.append(w) or new(w)
        want = [list(e.ids) for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):
            assert [tokens.as_ids(ids).tolist() for ids in enc.encode_batch(texts)] == want
        assert len(met) == len(set(met)) == len(enc.words) > 0
