import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from pairwell.llm import sharding


def check(placed, rows, shards=8):
    assert sorted(zip([r.doc_id for r in placed], [r.size for r in placed], [r.text_crc32 for r in placed]), key=str) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str
    )
    by = defaultdict(list)
    for r in placed:
        by[r.shard].append(r.slot)
    for s, slots in by.items():
        assert 0 <= s < shards and sorted(slots) == list(range(len(slots)))


def run(rows, make_docs, spark):
    docs = sharding.slotted(make_docs(rows))
    return docs, sharding.initial_map(sharding.slot_bytes(docs))


def test_all_rows_placed_gapless(spark, make_docs, odd_rows):
    docs, mapping = run(odd_rows, make_docs, spark)
    check(sharding.place(docs, mapping).collect(), odd_rows)


def test_near_equal_bytes(spark, make_docs):
    rows = [(i, "w" * (i * 37 % 500)) for i in range(3000)]
    docs, mapping = run(rows, make_docs, spark)
    placed = sharding.place(docs, mapping).collect()
    check(placed, rows)
    loads = defaultdict(int)
    for r in placed:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 8


def test_map_matches_greedy(spark, make_docs):
    rows = [(i, "w" * (i * 37 % 500)) for i in range(500)]
    docs, mapping = run(rows, make_docs, spark)
    sums = sorted(((-r.bytes, r.vslot) for r in sharding.slot_bytes(docs).collect()))
    loads, want = [0] * 8, {}
    for negative, slot in sums:
        want[slot] = loads.index(min(loads))
        loads[want[slot]] -= negative
    assert {r.vslot: r.shard for r in mapping.collect()} == want


def test_rebalance_moves_little_and_versions(spark, make_docs, tmp_path):
    rows = [(i, "w" * (i * 37 % 500)) for i in range(3000)]
    docs, mapping = run(rows, make_docs, spark)
    path = f"file://{tmp_path}/map"
    sharding.save_map(mapping, path)
    grown = sharding.rebalance(sharding.load_map(spark, path), sharding.slot_bytes(docs), 9)
    sharding.save_map(grown, path)
    old = {r.vslot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    new = {r.vslot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert old.keys() == new.keys()
    size = {r.vslot: r.bytes for r in sharding.load_map(spark, path, 1).collect()}
    moved = sum(size[s] for s in old if old[s] != new[s])
    assert 8 in new.values() and 0 < moved < 1.3 * sum(size.values()) / 9
    loads = sharding.load_map(spark, path).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert max(r.b for r in loads) < 1.1 * min(r.b for r in loads)


def test_empty(spark, make_docs):
    docs, mapping = run([], make_docs, spark)
    assert mapping.count() == 0 and sharding.place(docs, mapping).count() == 0


def test_query_edits_the_stored_map(spark, make_docs, odd_rows, tmp_path):
    for name, rows in (("some", odd_rows), ("none", [])):
        make_docs(rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        placed = sharding.op9_virtual_slots(spark, f"{tmp_path}/{name}").collect()
        check(placed, rows)
        assert {r.map_version for r in placed} == ({2} if rows else set())
