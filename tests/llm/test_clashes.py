"""Extra columns with the names that operators use inside change nothing."""

import pytest
from pyspark.sql import functions as F

from pairwell.llm import fingerprints, gif, packing, pieces, sharding, simhash, token_files
from pairwell.llm.tokens import tokenizer_path
from test_simhash import brute_fingerprint, groups, near

NAMES = "hash part fp label key tie visits n ids score vslot slot shard size bytes rows media canon keeper_id start words n_words node first_id".split()
BYTES, WORDS, PIECES = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def tokens(docs, path):
    token_files.write_token_files(docs, path, WORDS)
    return token_files.with_starts(token_files.read_token_files(docs.sparkSession, path)).select("doc_id", "start", "ids_crc32")


def shards(docs, _):
    rows = sharding.slotted(docs)
    return sharding.place(rows, sharding.initial_map(sharding.slot_bytes(rows))).select("doc_id", "size", "shard", "slot")


OPERATORS = {
    "fingerprints": lambda d, _: fingerprints.canonical_fingerprints(d),
    "simhash": lambda d, _: simhash.near_duplicates(d).select("doc_id", "fp", "component_id"),
    "gif": lambda d, _: gif.payload_features(gif.media_column(d)),
    "packing": lambda d, _: packing.pack(d, BYTES).drop("sequence_id"),
    "pieces": lambda d, _: pieces.encode(d, PIECES),
    "tokens": tokens,
    "shards": shards,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names(name, make_docs, odd_rows, tmp_path):
    docs = make_docs(odd_rows)
    clashing = docs.select("*", *[F.lit("clash").alias(c) for c in NAMES])
    plain, other = (OPERATORS[name](d, f"file://{tmp_path}/{i}") for i, d in enumerate((docs, clashing)))
    assert plain.columns == other.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, other.collect()))


def test_near_duplicate_filter_keeps_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    clashing = docs.select("*", *[F.lit("clash").alias(c) for c in NAMES])
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 3 in ids and 7 not in ids and 21 not in ids
    fps = [(i, brute_fingerprint(t, simhash.STAGE_WORDS)) for i, t in odd_rows]
    root, first = groups(sorted({f for _, f in fps}), near), {}
    for i, f in fps:
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    # 2 and 4 are the composed and the decomposed form of a letter: other bytes, so both stay
    assert sorted(i for i in ids if i is not None) == sorted(first.values()) == [2, 3, 4, 5, 13, 22, 23, 40, 41]
