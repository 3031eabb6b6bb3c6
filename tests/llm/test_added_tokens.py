from array import array

import pytest
from tokenizers import Tokenizer

from pairwell.llm import packing, token_files
from pairwell.llm.tokens import ByteEncoder, WordEncoder, encoder, tokenizer_path

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXTS = [
    "one <|endoftext|> two", "<|endoftext|>", "a<|startoftext|>b  <|endoftext|>\n", "<|endoftext|><|endoftext|>", "<|endoftext |>", "plain",
    "", "<|ENDOFTEXT|>", "é <|endoftext|> É́ 漢", "<|endoftext|> x<|startoftext|>", "plain",
]


def untouched(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("kind, path", [(ByteEncoder, BYTES), (WordEncoder, WORDS)])
def test_equals_the_untouched_tokenizer(kind, path):
    whole = untouched(path)
    for _ in range(2):  # the second time from the caches
        assert encoder(kind, path).encode_batch(TEXTS) == [whole(t) for t in TEXTS]


def test_operators(spark, make_docs, tmp_path):
    docs = make_docs(list(enumerate(TEXTS)))
    token_files.write_token_files(docs, f"file://{tmp_path}/t", WORDS)
    rows = token_files.with_starts(token_files.read_token_files(spark, f"file://{tmp_path}/t", with_ids=True)).collect()
    words, start = untouched(WORDS), 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        want = words(TEXTS[r.doc_id])
        assert r.start == start and array("I", r.ids).tobytes()[:-4] == want
        start += len(want) // 4 + 1
    packed = packing.pack(docs, BYTES, with_ids=True).collect()
    whole = untouched(BYTES)
    for i, text in enumerate(TEXTS):
        parts = sorted((r.start, bytes(r.ids)) for r in packed if r.doc_id == i)
        assert b"".join(p for _, p in parts)[:-4] == whole(text)
