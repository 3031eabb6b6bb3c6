"""Document fingerprints: a canonical exact digest.

A text is brought to canonical form (NFKC, case folding, NFKC again, runs of
white space to one space, ends trimmed) and hashed with 128-bit XXH3. Equal
hashes form a bucket; inside buckets of two or more documents the canonical
bytes are compared with those of one member, and a document that differs gets
a suffix from its SHA-256, so equal fingerprints mean equal canonical bytes.

Defined cases: a null text is the empty text; texts of white space only are
canonically empty; rows without an id come first in id order; repeated rows
are each other's neighbours; of equal ids the text with the smaller XXH3 hash
comes first; the last document's neighbour is the first, a lone document's is
itself; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.common import ddl_schema, materialize, read_table, record_batch, text_batches
from pairwell.llm.ordering import IdRanges, id_ranges

#: zstd level of texts on their way through a shuffle.
LEVEL = 3


def canonical(text: str | None) -> bytes:
    if not text:
        return b""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def packed_texts(source: DataFrame) -> DataFrame:
    """The texts as zstd frames of their UTF-8 bytes, for the shuffle; null is empty. tie: a hash of the text."""
    out = ddl_schema("doc_id long, tie long, text binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in text_batches(batches, "text"):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            ties = [xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw]
            yield record_batch([batch.column("doc_id"), ties, [pack(r) for r in raw]], out)

    return source.mapInArrow(run, "doc_id long, tie long, text binary")


def canonical_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and wide hash of every canonical text, straight from the scan."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = ddl_schema("doc_id long, hash string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            hashes = [digest(canonical(t)) for t in batch.column("text").to_pylist()]
            yield record_batch([batch.column("doc_id"), hashes], out)

    return source.mapInArrow(run, "doc_id long, hash string")


def bucket_members(hashes: DataFrame) -> DataFrame:
    """id and hash of the documents in buckets of two or more; narrow rows, hot buckets are split by the join."""
    shared = hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    return hashes.join(shared, "hash").select("doc_id", "hash").distinct()


def neighbours(docs: DataFrame, members: DataFrame, ranges: IdRanges) -> DataFrame:
    """Each document beside the next in id order: one shuffle of the texts, by range.

    The head of a part also visits the part before as its last row. Members of
    shared buckets travel along as markers before their document. Texts are
    zstd frames; a hash of the text orders rows of equal ids.
    """
    parts = ranges.count
    located = ranges.part(packed_texts(docs), "doc_id", "part")
    first, last = ranges.first(), len(ranges.heads)
    previous = F.when(F.col("part") == first, last).otherwise(F.col("part") - 1)
    head = F.col("doc_id").isNull() if ranges.has_null else F.lit(False)
    if ranges.heads:
        head = head | F.col("doc_id").isin(list(ranges.heads))
    place = lambda part, visits: F.struct(part.cast("int").alias("part"), F.lit(visits).alias("visits"))
    rows = located.select(
        "doc_id",
        "tie",
        "text",
        F.lit(None).cast("string").alias("hash"),
        F.explode(
            F.when(head, F.array(place(F.col("part"), False), place(previous, True))).otherwise(
                F.array(place(F.col("part"), False))
            )
        ).alias("at"),
    ).select("at.part", "at.visits", "doc_id", "tie", "text", "hash")
    markers = ranges.part(members, "doc_id", "part").select(
        F.col("part").cast("int").alias("part"),
        F.lit(False).alias("visits"),
        "doc_id",
        F.lit(None).cast("long").alias("tie"),
        F.lit(None).cast("binary").alias("text"),
        "hash",
    )
    return (
        rows.unionByName(markers)
        .repartitionById(max(parts, 1), F.col("part"))
        .sortWithinPartitions("part", "visits", F.asc_nulls_first("doc_id"), F.asc_nulls_first("tie"))
    )


FINGERPRINTED = (
    "doc_id long, n_chars long, edited_sha256 string, hash string, edited_hash string, "
    "near_edited double, near_next double, canon binary"
)


def edited_text(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut] if cut else text


def _row(doc_id: int | None, text: str, canon: bytes, own: str, marked: set[str], following: str, next_canon: bytes) -> tuple:
    edited = edited_text(text, following)
    edited_canon = canonical(edited) if edited != text else canon
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        own,
        own if edited_canon == canon else digest(edited_canon),
        float(edited_canon == canon),
        float(next_canon == canon),
        zstandard.compress(canon, LEVEL) if own in marked else None,
    )


def fingerprint_rows(ordered: DataFrame) -> DataFrame:
    """Streams the sorted rows once: hashes, the edited text's, and the canonical bytes of bucket members."""
    out = ddl_schema(FINGERPRINTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        pending, marked, marked_id, ready = None, set(), None, []
        for batch in text_batches(batches, "text"):
            columns = (batch.column(c).to_pylist() for c in ("part", "visits", "doc_id", "text", "hash"))
            for part, visits, doc_id, text, mark in zip(*columns):
                if mark is not None:
                    marked = marked | {mark} if marked_id == (doc_id,) else {mark}
                    marked_id = (doc_id,)
                    continue
                text = unpack(text).decode("utf-8", "surrogatepass")
                canon = canonical(text)
                if pending is not None and pending[0] == part:
                    ready.append(_row(*pending[1:], text, canon))
                    pending = None
                if not visits:
                    own = digest(canon)
                    pending = (part, doc_id, text, canon, own, marked if marked_id == (doc_id,) else set())
            yield record_batch(list(zip(*ready)) or [[]] * len(out), out)
            ready = []

    return ordered.mapInArrow(run, FINGERPRINTED)


def _differing(members: DataFrame) -> DataFrame:
    """Of members whose frame is not the first's, those whose bytes differ too."""
    out = ddl_schema("doc_id long, hash string, suffix string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = unpack(r["canon"])
                if own != unpack(r["first"]):
                    rows.append((r["doc_id"], r["hash"], hashlib.sha256(own).hexdigest()[:16]))
            yield record_batch(list(zip(*rows)) or [[]] * 3, out)

    return members.mapInArrow(run, "doc_id long, hash string, suffix string")


def verified(rows: DataFrame) -> DataFrame:
    """Compares canonical bytes (zstd frames) inside buckets; whoever differs from the bucket's first gets a suffix.

    The least and the greatest frame of a bucket are found where its members are, so a hot bucket sends two
    frames a task; only members of a bucket in which they differ are joined with its first.
    """
    members = rows.filter(F.col("canon").isNotNull()).select("doc_id", "hash", "canon")
    first = members.groupBy("hash").agg(F.min("canon").alias("first"), F.max("canon").alias("last")).filter("first <> last").select("hash", "first")
    odd = members.join(first, "hash").filter(F.col("canon") != F.col("first"))
    odd = _differing(odd).distinct()
    odd = odd.select(F.col("doc_id").alias("odd_id"), F.col("hash").alias("odd_hash"), "suffix")
    same = F.col("doc_id").eqNullSafe(F.col("odd_id")) & (F.col("hash") == F.col("odd_hash"))
    return rows.drop("canon").join(odd, same, "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.concat_ws("-", "hash", "suffix").alias("fingerprint"),
        F.when(F.col("near_edited") == 1, F.concat_ws("-", "hash", "suffix")).otherwise(F.col("edited_hash")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def canonical_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document and of its edited text, with exact likenesses (1 or 0)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashes = materialize(canonical_hashes(source), "fingerprint-hashes")
    ordered = neighbours(source, bucket_members(hashes), id_ranges(hashes, "doc_id"))
    return verified(materialize(fingerprint_rows(ordered), "fingerprint-rows"))


def op10_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of documents and of its edited text."""
    return canonical_fingerprints(read_table(spark, sf_dir, "documents"))
