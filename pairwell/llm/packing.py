"""Packing by powers of two: no sequence crosses documents.

A document of n ids gives floor(n / 1024) pieces of 1024 and one piece for each
bit of the rest, the longest first. A piece fills its sequence, so nothing is
padded, and sequences of one length form a bucket: sequence ids run through
the buckets from the longest, in them by document id and start.

Defined cases: a null text is the empty text, one end id; repeated rows give
their own sequences; rows without an id come first in their bucket; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.common import ddl_schema, materialize, read_table, record_batch, text_batches
from pairwell.llm.ordering import id_ranges, running_total
from pairwell.llm.tokens import ByteEncoder, encoder, tokenizer_path

LENGTH = 1024
END_ID = 0


def piece_lengths(n: int, longest: int = LENGTH) -> list[int]:
    """The binary decomposition of n with pieces of at most `longest`, itself a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, longest: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row per piece of each document; with_ids adds its ids as little-endian u32 bytes."""
    ddl = PIECES + (", ids binary" if with_ids else "")
    out = ddl_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ByteEncoder, tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in text_batches(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_batch(batch.column("text").to_pylist())):
                ids += end
                n, at = len(ids) // 4, 0
                for length in piece_lengths(n, longest):
                    piece = ids[4 * at : 4 * (at + length)]
                    rows.append((doc_id, at, length, zlib.crc32(piece), n, piece)[: len(out)])
                    at += length
            yield record_batch(list(zip(*rows)), out)

    return docs.mapInArrow(run, ddl)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence: sequence_id, and offset, which is always 0."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = materialize(pieces(source, tokenizer, with_ids=with_ids), "pieces")
    ranges = id_ranges(cut, "doc_id")
    bucket = (F.lit(LENGTH.bit_length()) - F.length(F.bin("length"))).cast("int")
    placed = ranges.part(cut, "doc_id", "id_part").withColumn("part", bucket * ranges.count + F.col("id_part"))
    order = [F.asc_nulls_first("doc_id"), F.col("start"), F.col("doc_tokens"), F.col("ids_crc32")]
    return (
        running_total(placed, "part", order, F.lit(1).cast("long"), "sequence_id")
        .withColumn("offset", F.lit(0).cast("long"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def op8_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of power-of-two lengths up to 1024."""
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
