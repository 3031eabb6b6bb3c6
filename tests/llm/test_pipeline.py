"""Every stage against a plain version on its own input, on the driver's smallest table and some odd rows."""

import os
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pairwell.llm import language, packing, quality
from pairwell.llm.common import materialize
from pairwell.llm.tokens import tokenizer_path
from test_similar import jaccard_at_least, shingles
from test_simhash import groups

SF = "/root/testdata/sf0.001"
EXTRA = {"quality_score": 1, "Found_Language": "x", "keeper_id": None, "_keeper_id": 2, "id": 9, "label": "k"}


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").filter(F.length("text").between(200, 2000)).limit(4)
    copies = first.withColumn("doc_id", F.col("doc_id") + 1_000_000).union(first).union(first.withColumn("text", F.concat("text", F.lit(" extra words"))).withColumn("doc_id", F.col("doc_id") + 2_000_000))
    odd = spark.createDataFrame([(5_000_000, None), (5_000_001, ""), (None, "The people of the town have read this in the paper and they know that it is not so."), (5_000_002, " \n"), (None, None)], "doc_id long, text string")
    odd = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = docs.unionByName(copies).unionByName(odd)
    for name, value in EXTRA.items():
        docs = docs.withColumn(name, F.lit(value).cast("string"))
    made = [("input", materialize(docs, "pipeline-test"))]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made.append((name, materialize(stage(spark, made[-1][1], SF), name)))
    made.append(("packing", corpus_pipeline.STAGES[-1][1](spark, made[-1][1], SF)))
    return dict(made)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "packing"]


def test_columns_stay(stages):
    for name in ("quality", "language", "near_duplicates"):
        assert stages[name].columns == stages["input"].columns


def test_quality_keeps_what_the_model_keeps(stages):
    model = quality.train(stages["input"])
    assert rows(stages["quality"]) == sorted((tuple(r) for r in stages["input"].collect() if model.score(r.text) >= quality.KEEP_AT), key=str)


def test_language_keeps_what_the_model_tells(stages):
    model = language.train(stages["quality"])
    told = {}
    for r in stages["quality"].collect():
        lang, p = model.predict(r.text)
        told[tuple(r)] = lang != language.UNKNOWN and p >= language.KEEP_AT
    assert rows(stages["language"]) == sorted((tuple(r) for r in stages["quality"].collect() if told[tuple(r)]), key=str)


def test_one_document_of_each_group_stays(stages):
    found = stages["language"].collect()
    sets = [shingles(r.text) for r in found]
    root = groups(list(range(len(found))), lambda a, b: jaccard_at_least(sets[a], sets[b]))
    least = {}
    for k, r in enumerate(found):
        if r.doc_id is not None:
            least[root[k]] = min(r.doc_id, least.get(root[k], r.doc_id))
    kept = [r.doc_id for r in stages["near_duplicates"].collect() if r.doc_id is not None]
    assert sorted(kept) == sorted(least.values()) and not [i for i in kept if i > 900_000]
    assert stages["near_duplicates"].filter("doc_id IS NULL").count() == stages["language"].filter("doc_id IS NULL").count()


def test_packing_holds_every_id_once(stages):
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for r in stages["near_duplicates"].collect():
        ids, at = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [packing.END_ID], 0
        for n in packing.piece_lengths(len(ids)):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at : at + n])
            want.append((r.doc_id, at, n, zlib.crc32(raw), len(ids)))
            at += n
    got = stages["packing"].collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and {r.offset for r in got} == {0}


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
