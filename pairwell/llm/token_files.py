"""Token ids in Simple-8b files, in ascending id order, and their reader.

Texts are tokenised where they are scanned; only coded ids are shuffled, by
range of the document id. A file is a run of blocks, each closed by END:

    magic S8B1 | part i32 | documents u32 | words u64 | start i64
    has_id u8[documents] | doc_id i64[] | tokens i64[] | words i64[] | u64[words]

All numbers are little-endian. `start` counts the ids of the part before the
block; the per-document word counts are the block's offsets, so a reader
decodes a block, or one document of it, with array operations only. Spark's
text writer commits the blocks (END is its line separator), so files can be on
any store that Spark writes to, and a lost task leaves nothing behind.

Defined cases: a null text is the empty text, one end id; rows without an id
come first; of equal ids the one with fewer ids comes first; an empty table
gives no files and no rows; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwell.llm import simple8b
from pairwell.llm.common import ddl_schema, fresh_path, materialize, read_table, record_batch, text_batches
from pairwell.llm.ordering import id_ranges
from pairwell.llm.tokens import WordEncoder, as_ids, encoder, tokenizer_path

MAGIC, END = b"S8B1", b"S8BE"
HEAD = struct.Struct("<4siIQq")
#: Bytes of coded ids in a block, about; blocks in a file.
BLOCK_BYTES = 1 << 20
BLOCKS_PER_FILE = 64
END_ID = 2

CODED = "doc_id long, n_tokens long, n_words long, words binary"


def coded_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Each document's ids, end id included, as Simple-8b words."""
    out = ddl_schema(CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(WordEncoder, tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in text_batches(batches, "text"):
            raw = [ids + end for ids in enc.encode_batch(batch.column("text").to_pylist())]
            counts = np.array([len(r) // 4 for r in raw], np.int64)
            words, per = simple8b.encode(as_ids(b"".join(raw)), counts)
            data, ends = words.astype("<u8").tobytes(), (np.cumsum(per) * 8).tolist()
            cut = [data[a:b] for a, b in zip([0, *ends], ends)]
            yield record_batch([batch.column("doc_id"), counts, per, cut], out)

    return docs.mapInArrow(run, CODED)


def _block(part: int, start: int, rows: list[tuple]) -> bytes:
    ids = np.array([r[0] if r[0] is not None else 0 for r in rows], "<i8")
    return b"".join(
        [
            HEAD.pack(MAGIC, part, len(rows), sum(r[2] for r in rows), start),
            bytes(r[0] is not None for r in rows),
            ids.tobytes(),
            np.array([r[1] for r in rows], "<i8").tobytes(),
            np.array([r[2] for r in rows], "<i8").tobytes(),
            *(r[3] for r in rows),
        ]
    )


def blocks(ordered: DataFrame) -> DataFrame:
    """Rows sorted by part and id, streamed into blocks."""
    out = ddl_schema("value binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, part, start, behind = [], 0, None, 0, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "n_words", "words"))
            for p, doc_id, n_tokens, n_words, words in zip(*columns):
                if rows and (p != part or size >= BLOCK_BYTES):
                    yield record_batch([[_block(part, start, rows)]], out)
                    start, rows, size = start + behind, [], 0
                    behind = 0
                if p != part:
                    part, start, behind = p, 0, 0
                rows.append((doc_id, n_tokens, n_words, words))
                size += len(words)
                behind += n_tokens
        if rows:
            yield record_batch([[_block(part, start, rows)]], out)

    return ordered.mapInArrow(run, "value binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenises all documents and writes their ids in ascending id order."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = id_ranges(source, "doc_id")
    ordered = (
        ranges.part(coded_documents(source, tokenizer), "doc_id", "part")
        .repartitionById(ranges.count, F.col("part"))
        .sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "n_tokens", "words")
    )
    lines = blocks(ordered).select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


def _parse(data: bytes) -> Iterator[tuple]:
    """part, start, has_id, doc_ids, counts, word counts, words of each block of a file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        magic, part, n_docs, n_words, start = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        has = np.frombuffer(view, np.uint8, n_docs, at).astype(bool)
        at += n_docs
        ids, counts, per = (np.frombuffer(view, "<i8", n_docs, at + 8 * n_docs * k) for k in range(3))
        at += 24 * n_docs
        words = np.frombuffer(view, "<u8", n_words, at)
        at += 8 * n_words
        if data[at : at + len(END)] != END:
            raise ValueError(f"block not closed at byte {at}")
        at += len(END)
        yield part, start, has, ids, counts, per, words


READ = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row per document: its part, start within the part, count and crc32; with_ids adds the ids themselves."""
    ddl = READ + (", ids array<long>" if with_ids else "")
    out = ddl_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for part, start, has, ids, counts, per, words in _parse(content.as_py()):
                    flat = simple8b.decode(words, per, counts)
                    low, ends = flat.astype("<u4"), np.cumsum(counts)
                    starts = ends - counts
                    crcs = [zlib.crc32(low[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    doc_ids = pa.array(ids, pa.int64(), mask=~has)
                    columns = [np.full(len(ids), part), doc_ids, start + starts, counts, crcs]
                    if with_ids:
                        columns.append([flat[a:b].astype(np.int64) for a, b in zip(starts.tolist(), ends.tolist())])
                    yield record_batch(columns, out)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all documents before: a base per part plus the start within it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("local_start"))


def op5_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into Simple-8b files, and the files read back."""
    path = fresh_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    rows = materialize(read_token_files(spark, path), "token-rows")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
