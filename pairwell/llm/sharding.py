"""Sharding by fixed virtual slots, in DataFrame functions only.

Records hash into `slots` virtual slots. Bytes are summed per slot, and a map
from slot to shard is folded from those sums: the largest slots first, each to
the shard with the least bytes so far. The map is a versioned table; a
rebalance writes a new version that moves whole slots and leaves the rest.

Defined cases: a null text has size 1 and its slot hashes its id; a null id
hashes the text, so a run of null ids spreads; repeated rows share a slot and
take different positions; an empty table gives an empty map and no rows; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwell.llm.common import fresh_path, read_table

#: Fixed number of virtual slots; a shard map never has more rows.
SLOTS = 4096
SHARDS = 8
MAP = "vslot int, bytes long, rows long, shard int, version int"


def virtual_slot(id_col: str, text_col: str, slots: int = SLOTS) -> Column:
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text_col), F.lit(""))))
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each record; the text itself is never shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot(id_col, text_col, slots).alias("vslot"),
    )


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def initial_map(sums: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the slot-to-shard map: vslot, bytes, rows, shard, version.

    One row per slot enters the fold, so its array is bounded by the slot count.
    """
    order = F.array_sort(
        F.collect_list(F.struct((-F.col("bytes")).alias("negative"), F.col("vslot"), F.col("bytes"), F.col("rows")))
    )
    packed = sums.agg(order.alias("slots")).withColumn(
        "folded",
        F.expr(
            f"""aggregate(slots,
                struct(array_repeat(0L, {shards}) AS loads, cast(array() AS array<int>) AS picks),
                (acc, s) -> struct(
                    transform(acc.loads, (b, i) -> if(i + 1 = array_position(acc.loads, array_min(acc.loads)), b + s.bytes, b)) AS loads,
                    array_append(acc.picks, cast(array_position(acc.loads, array_min(acc.loads)) - 1 AS int)) AS picks))"""
        ),
    )
    entry = F.explode(F.arrays_zip(F.col("slots"), F.col("folded.picks").alias("picks")))
    return packed.select(entry.alias("e")).select(
        F.col("e.slots.vslot").alias("vslot"),
        F.col("e.slots.bytes").alias("bytes"),
        F.col("e.slots.rows").alias("rows"),
        F.col("e.picks").alias("shard"),
        F.lit(1).alias("version"),
    )


def even_map(sums: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of a map made before any sizes are known: slots are dealt to the shards by number."""
    return sums.select("vslot", "bytes", "rows", F.pmod("vslot", F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("version"))


def rebalance(current: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for new byte sums and `shards` shards.

    Slots stay where they are unless their shard is over its fair share; what is
    over, smallest slots first, goes to the shards with the least bytes. New
    slots are placed as well. A shard that is no longer there gives up all.
    """
    known = sums.join(current.select("vslot", "shard", "version"), "vslot", "left")
    version = current.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next"))
    share = sums.agg((F.sum("bytes") / shards).alias("share"))
    filled = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    kept = (
        known.crossJoin(F.broadcast(share))
        .withColumn("shard", F.when(F.col("shard") < shards, F.col("shard")))
        .withColumn("filled", F.sum("bytes").over(filled))
        .withColumn("shard", F.when(F.col("filled") <= F.col("share"), F.col("shard")))
    )
    order = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("shard").isNull().alias("loose"),
                (-F.col("bytes")).alias("negative"),
                F.col("vslot"),
                F.col("bytes"),
                F.col("rows"),
                F.coalesce(F.col("shard"), F.lit(-1)).alias("shard"),
            )
        )
    )
    folded = kept.agg(order.alias("slots")).withColumn(
        "picks",
        F.expr(
            f"""aggregate(slots,
                struct(array_repeat(0L, {shards}) AS loads, cast(array() AS array<int>) AS picks),
                (acc, s) -> struct(
                    transform(acc.loads, (b, i) -> if(i + 1 = if(s.loose, array_position(acc.loads, array_min(acc.loads)), s.shard + 1), b + s.bytes, b)) AS loads,
                    array_append(acc.picks, cast(if(s.loose, array_position(acc.loads, array_min(acc.loads)) - 1, s.shard) AS int)) AS picks)).picks"""
        ),
    )
    entry = F.explode(F.arrays_zip(F.col("slots"), F.col("picks")))
    return (
        folded.select(entry.alias("e"))
        .select(
            F.col("e.slots.vslot").alias("vslot"),
            F.col("e.slots.bytes").alias("bytes"),
            F.col("e.slots.rows").alias("rows"),
            F.col("e.picks").alias("shard"),
        )
        .crossJoin(F.broadcast(version))
        .withColumnRenamed("next", "version")
    )


def save_map(mapping: DataFrame, path: str) -> None:
    """Appends a version to the stored map, a folder partitioned by version."""
    mapping.repartition(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, by default the latest."""
    stored = spark.read.schema(MAP).parquet(path)  # an empty map has no file to tell its columns
    if version is None:
        version = stored.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    return stored.filter(F.col("version") == version)


def place(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Shard and position of each record: the slot's offset in its shard plus the rank within the slot.

    The map has at most one row per slot and is broadcast; ranking partitions by slot.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = mapping.select("vslot", "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(offsets), "vslot")
        .withColumn("slot", F.col("offset") + F.col("rank") - 1)
    )


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 8 shards of near equal bytes: a stored map made before sizes are known, edited by a rebalance."""
    rows = slotted(read_table(spark, sf_dir, "documents"))
    path, sums = fresh_path(spark, "shard-map"), fresh_path(spark, "slot-bytes")
    slot_bytes(rows).write.parquet(sums)
    sums = spark.read.parquet(sums)
    save_map(even_map(sums), path)
    save_map(rebalance(load_map(spark, path), sums, SHARDS), path)
    return place(rows, load_map(spark, path)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        F.col("version").cast("int").alias("map_version"),
    )
