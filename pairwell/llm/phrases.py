"""Phrase collocations from depth-limited count tries.

Each task counts the phrases of one to three words of its shard in tries: a
trie is kept as sorted level columns (word numbers in byte order, counts), so
building one is a sort, not a walk over objects. A trie is cut at the borders
of prefix ranges and each cut is serialised in preorder (depth, last word,
count; zstd). A range's blocks meet in one partition, sorted by their first
phrase, and are merged as they stream in; what no later block can touch is
final and leaves. Walking up the merged trie gives left parts; suffix links
(a phrase without its first word) are joins and give right parts.

Keys are phrases with a space behind each word, so that no word is a prefix
of another and byte order is the trie's preorder. Borders come from a sample
of SAMPLE documents; they decide which task merges what, never a result.

Defined cases: a null text has no words, a null language is `und`; rows
without an id count like others (ids are not read), repeated rows count as
often as they occur; very long texts are cut at separators into tries of
about TRIE_BYTES; ties go by score, count and bytes of the phrase; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwell.llm.common import ddl_schema, materialize, parallelism, read_table, record_batch, text_batches

DEPTH = 3
#: Documents that the ranges' borders are taken from; trie nodes a range aims at; ranges at most.
SAMPLE, RANGE_NODES, MOST_RANGES = 4000, 1_500_000, 65_536
#: UTF-8 bytes of text in one trie, and nodes that a merge holds before it lets final ones go.
TRIE_BYTES, MERGE_NODES = 12 << 20, 3_000_000
#: Partial tops a language before the last sort.
TOP_PARTS = 16

#: A to Z in lower case; what ends a piece as a line feed; a tab as a space.
FOLD = bytes(10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = 21


@dataclass
class Trie:
    """words: sorted, each with a space behind it. levels: for each node, in preorder, the number of its first, second and third word, from 1; 0 if none."""

    words: list[bytes]
    levels: list[np.ndarray]
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)

    def key(self, i: int) -> bytes:
        return b"".join(self.words[level[i] - 1] for level in self.levels if level[i])

    def find(self, key: bytes) -> int:
        """The first node whose key is not below `key`."""
        low, high, tokens = 0, len(self), key.split(b" ")[:-1]
        for level, token in zip(self.levels, tokens):
            at = bisect_left(self.words, token + b" ")
            part = level[low:high]
            low, high = low + int(np.searchsorted(part, at + 1)), low + int(np.searchsorted(part, at + 1, "right"))
            if at == len(self.words) or self.words[at] != token + b" ":
                return low
        return low

    def depths(self) -> np.ndarray:
        return sum((level > 0).astype(np.uint8) for level in self.levels)

    def take(self, nodes: np.ndarray) -> Trie:
        return Trie(self.words, [level[nodes] for level in self.levels], self.counts[nodes])

    def above(self, key: bytes) -> np.ndarray:
        """Nodes whose phrase begins `key` and ends before it does."""
        tokens, found = key.split(b" ")[:-1], []
        for n in range(1, len(tokens)):
            prefix = b"".join(t + b" " for t in tokens[:n])
            i = self.find(prefix)
            if i < len(self) and self.key(i) == prefix:
                found.append(i)
        return np.array(found, np.int64)


def _summed(levels: list[np.ndarray], counts: np.ndarray | None, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal nodes added up, in preorder. counts: None for one each; most: the largest word number."""
    if most < 1 << BITS:
        packed = (levels[0].astype(np.int64) << 2 * BITS) | (levels[1].astype(np.int64) << BITS) | levels[2]
        if counts is None:
            keys, totals = np.unique(packed, return_counts=True)
        else:
            order = np.argsort(packed, kind="stable")
            keys = packed[order]
            firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            totals, keys = np.add.reduceat(counts[order], firsts) if len(keys) else counts, keys[firsts]
        mask = (1 << BITS) - 1
        return [(keys >> 2 * BITS).astype(np.int32), (keys >> BITS & mask).astype(np.int32), (keys & mask).astype(np.int32)], totals
    counts = np.ones(len(levels[0]), np.int64) if counts is None else counts
    order = np.lexsort(levels[::-1])
    levels = [level[order] for level in levels]
    fresh = np.concatenate(([True], np.any([level[1:] != level[:-1] for level in levels], axis=0)))
    firsts = np.flatnonzero(fresh)
    return [level[firsts].astype(np.int32) for level in levels], np.add.reduceat(counts[order], firsts)


def _ranked(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct words in byte order, and each word's number from 1. The words have their space."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)).to_pylist(), rank[coded.indices.to_numpy()]


def count_trie(data: bytes) -> Trie:
    """The trie of folded text: phrases of one to three words inside its lines."""
    chars = np.frombuffer(data, np.uint8)
    gap = (chars == 32) | (chars == 10)
    edges = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return Trie([], [np.zeros(0, np.int32)] * DEPTH, np.zeros(0, np.int64))
    line = np.cumsum(chars == 10)[starts]
    # each word with the one character behind it, made a space
    body = np.concatenate((chars, [32])).astype(np.uint8)
    body[ends] = 32
    keep = np.zeros(len(body), bool)
    keep[:-1] = ~gap
    keep[ends] = True
    offsets = np.concatenate(([0], np.cumsum(ends - starts + 1))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body[keep])])
    names, ids = _ranked(words)
    none = np.zeros(len(ids), np.int32)
    two, three = line[1:] == line[:-1], line[2:] == line[:-2]
    levels = [
        np.concatenate((ids, ids[:-1][two], ids[:-2][three])),
        np.concatenate((none, ids[1:][two], ids[1:-1][three])),
        np.concatenate((none, none[1:][two], ids[2:][three])),
    ]
    return Trie(names, *_summed(levels, None, len(names)))


def merged(tries: list[Trie]) -> Trie:
    """One trie with the counts of several."""
    every = pa.concat_arrays([pa.array(t.words, pa.binary()) for t in tries])
    names, numbers = _ranked(every)
    at, levels = 0, [[], [], []]
    for t in tries:
        own = np.concatenate(([0], numbers[at : at + len(t.words)])).astype(np.int32)
        at += len(t.words)
        for out, level in zip(levels, t.levels):
            out.append(own[level])
    return Trie(names, *_summed([np.concatenate(x) for x in levels], np.concatenate([t.counts for t in tries]), len(names)))


def _planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers as byte planes, which compress better than rows."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.int64)


def pack_trie(t: Trie) -> bytes:
    """Preorder block: depth, last word and count of each node, then the block's own words. Every node's ancestors must be in it."""
    depths = t.depths()
    last = np.choose(depths - 1, t.levels)
    used, own = np.unique(last, return_inverse=True)
    words = [t.words[i - 1] for i in used.tolist()]
    wide = lambda x: max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    own_width, count_width = wide(own), wide(t.counts)
    text = b"".join(words)
    head = np.array([len(t), len(words), own_width, count_width], "<u8").tobytes()
    parts = (head, depths.tobytes(), _planes(own, own_width), _planes(t.counts, count_width), text)
    return zstandard.compress(b"".join(parts), 3)


def unpack_trie(block: bytes) -> Trie:
    raw = zstandard.decompress(block)
    n, n_words, own_width, count_width = np.frombuffer(raw[:32], "<u8").tolist()
    at = 32 + n
    depths = np.frombuffer(raw[32:at], np.uint8)
    own = _unplaned(raw[at : at + n * own_width], n, own_width)
    at += n * own_width
    counts = _unplaned(raw[at : at + n * count_width], n, count_width)
    text = raw[at + n * count_width :]
    words = [w + b" " for w in text.split(b" ")[:-1]]
    place, levels = np.arange(n), []
    for depth in range(1, DEPTH + 1):
        latest = np.maximum.accumulate(np.where(depths == depth, place, -1))
        level = np.where((depths >= depth) & (latest >= 0), own[latest] + 1, 0)
        levels.append(level.astype(np.int32))
    return Trie(words, levels, counts)


@dataclass(frozen=True)
class PrefixRanges:
    """borders: (language, key) of each range's first phrase, ascending; the first is the least of all."""

    borders: tuple[tuple[str, bytes], ...]

    def of(self, lang: str) -> Iterator[tuple[int, bytes, bytes | None]]:
        """Number, first key and end of the ranges that hold phrases of a language; no end: None."""
        for r in range(bisect_right(self.borders, (lang, b"")) - 1, len(self.borders)):
            at, key = self.borders[r]
            if at > lang:
                return
            after = self.borders[r + 1] if r + 1 < len(self.borders) else None
            yield r, key if at == lang else b"", after[1] if after and after[0] == lang else None

    def cut(self, lang: str, t: Trie) -> Iterator[tuple[int, str, bytes, bytes]]:
        """Rows (range, language, first key, block) of one trie. What stands above a range's first key goes there too, with key ''."""
        for r, first, end in self.of(lang):
            low, high = t.find(first), len(t) if end is None else t.find(end)
            if high > low:
                block = t.take(np.concatenate((ancestors(t, low), np.arange(low, high))))
                block.counts[: len(block) - (high - low)] = 0
                yield r, lang, t.key(low), pack_trie(block)
            if len(above := t.above(first)):
                # zero counts keep the block whole where a shard lacks nothing: ancestors of ancestors are in it
                yield r, lang, b"", pack_trie(t.take(above))


def ancestors(t: Trie, i: int) -> np.ndarray:
    """The nodes above node i."""
    return t.above(t.key(i))


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Trie]]:
    """Tries of a task's texts by language, a new set whenever the texts pass TRIE_BYTES."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in text_batches(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
            while len(data) > TRIE_BYTES and (at := data.find(b"\n", TRIE_BYTES)) >= 0:
                yield lang, count_trie(data[:at])
                data = data[at:]
            held[lang].append(data)
            size += len(data)
            if size > TRIE_BYTES:
                yield from ((k, count_trie(b"\n".join(v))) for k, v in held.items())
                held, size = defaultdict(list), 0
    yield from ((k, count_trie(b"\n".join(v))) for k, v in held.items())


def prefix_ranges(source: DataFrame) -> PrefixRanges:
    """Ranges of about RANGE_NODES nodes, from evenly spaced keys of a sample's tries; a row for each 512 nodes comes to the driver, 1024 a trie at most."""
    total = source.count()
    share = min(1.0, SAMPLE / max(total, 1))
    sampled = source if share == 1 else source.sample(share, seed=12)
    out = ddl_schema("lang string, key binary, nodes double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, t in _tries(batches):
            step = max(512, -(-len(t) // 1024))
            rows = [(lang, t.key(i), min(step, len(t) - i)) for i in range(0, len(t), step)]
            yield record_batch(list(zip(*rows)) or [[]] * 3, out)

    picks = sorted((r.lang, bytes(r.key), r.nodes) for r in sampled.mapInArrow(run, "lang string, key binary, nodes double").collect())
    nodes = sum(p[2] for p in picks)
    wanted = min(MOST_RANGES, max(parallelism(source.sparkSession), round(nodes / share / RANGE_NODES)))
    borders, passed = [("", b"")], 0.0
    for lang, key, n in picks:
        if passed >= nodes * len(borders) / wanted and (lang, key) > borders[-1]:
            borders.append((lang, key))
        passed += n
    return PrefixRanges(tuple(borders))


NODES = "lang string, phrase string, depth int, f long, first_f long, second_f long"


def _final(lang: str, t: Trie, low: bytes, end: bytes | None, least: int) -> tuple[list[tuple], Trie | None]:
    """Rows of the nodes in [low, end), and what is left: the nodes from `end` on with those above it."""
    first, stop = t.find(low), len(t) if end is None else t.find(end)
    depths, place = t.depths(), np.arange(len(t))
    ones = np.maximum.accumulate(np.where(depths == 1, place, 0))
    twos = np.maximum.accumulate(np.where(depths == 2, place, 0))
    inside = slice(first, stop)
    words = int(t.counts[inside][depths[inside] == 1].sum())
    rows = [(lang, "", 0, words, 0, 0)] if words else []
    for i in (first + np.flatnonzero(t.counts[inside] >= least)).tolist():
        phrase = t.key(i)[:-1].decode("utf-8", "replace")
        depth = int(depths[i])
        rows.append((lang, phrase, depth, int(t.counts[i]), int(t.counts[ones[i]]), int(t.counts[twos[i]]) if depth == DEPTH else 0))
    left = None if end is None else t.take(np.concatenate((t.above(end), np.arange(stop, len(t)))))
    return rows, left


def merge_ranges(blocks: DataFrame, ranges: PrefixRanges, least: int) -> DataFrame:
    """Nodes that occur `least` times or more, with the counts of their first one and two words; depth 0 carries word counts.

    The blocks of a range come in the order of their first keys; nodes below the next first key are final.
    """
    out = ddl_schema(NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pending, size, low = None, [], 0, b""

        def close(end: bytes | None) -> list[tuple]:
            nonlocal pending, size, low
            rows, left = _final(group[1], merged(pending), low, end, least)
            pending, size, low = ([left] if left else []), len(left or ()), end or b""
            return rows

        for batch in batches:
            rows = []
            for r, lang, first, block in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "first", "block"))):
                if group != (r, lang):
                    rows += close(None) if pending else []
                    group = (r, lang)
                    low = ranges.borders[r][1] if ranges.borders[r][0] == lang else b""
                elif size > MERGE_NODES and first > low:
                    rows += close(first)
                pending.append(unpack_trie(block))
                size += len(pending[-1])
            yield record_batch(list(zip(*rows)) or [[]] * len(out), out)
        if pending:
            yield record_batch(list(zip(*close(None))) or [[]] * len(out), out)

    return (
        blocks.repartitionById(len(ranges.borders), F.col("range"))
        .sortWithinPartitions("range", "lang", "first")
        .mapInArrow(run, NODES)
    )


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns NODES: every phrase of one to three words with `least` occurrences in its language, with the counts of its beginnings."""
    source = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    ranges = prefix_ranges(source)
    ddl = "range int, lang string, first binary, block binary"
    out = ddl_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, t in _tries(batches):
            for row in ranges.cut(lang, t):
                yield record_batch([[x] for x in row], out)

    return merge_ranges(source.mapInArrow(run, ddl), ranges, least)


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's best phrases of two and three words: lang, rank, phrase, a, l, r, n, score.

    A phrase inside a longer one with `covered` percent of its count goes. Products are decimals of 38 digits.
    """
    nodes = materialize(phrase_counts(docs, least, text_col, lang_col), "phrase-nodes")
    of = lambda depth: nodes.filter(F.col("depth") == depth)
    words = of(0).groupBy("lang").agg(F.sum("f").alias("n"))
    suffix = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    ones = of(1).select("lang", F.col("phrase").alias("suffix"), F.col("f").alias("suffix_f"))
    twos = of(2).withColumn("suffix", suffix).join(ones, ["lang", "suffix"])
    linked = twos.select("lang", F.col("phrase").alias("suffix"), F.col("f").alias("suffix_f"), F.col("suffix_f").alias("last_f"))
    threes = of(3).withColumn("suffix", suffix).join(linked, ["lang", "suffix"])
    inside = (
        of(3)
        .select("lang", "f", F.explode(F.array(F.substring_index("phrase", " ", 2), suffix)).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    cut = lambda l, r: f"(CAST(1000000 AS DECIMAL(7, 0)) * CAST(CAST(f AS DECIMAL(19, 0)) * f AS DECIMAL(31, 0))) div (CAST({l} AS DECIMAL(19, 0)) * {r})"
    one = twos.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("f") * covered, F.lit(True)))
    one = one.select("lang", "phrase", "f", F.col("first_f").alias("l"), F.col("suffix_f").alias("r"), F.expr(cut("first_f", "suffix_f")).alias("score"))
    early, late = F.expr(cut("first_f", "suffix_f")), F.expr(cut("second_f", "last_f"))
    two = threes.withColumns({"early": early, "late": late}).select(
        "lang",
        "phrase",
        "f",
        F.when(F.col("early") <= F.col("late"), F.col("first_f")).otherwise(F.col("second_f")).alias("l"),
        F.when(F.col("early") <= F.col("late"), F.col("suffix_f")).otherwise(F.col("last_f")).alias("r"),
        F.least("early", "late").alias("score"),
    )
    best = (F.desc("score"), F.desc("f"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    partial = Window.partitionBy("lang", "part").orderBy(*best)
    scored = one.unionByName(two).withColumn("part", part).withColumn("rank", F.row_number().over(partial)).filter(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", F.col("score").cast("long").alias("score")
    )


def op12_count_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of documents."""
    return collocations(read_table(spark, sf_dir, "documents"))


#: The same counts by plain grouping.
OP12_SQL = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
    FROM documents
), pieces AS (
    SELECT lang, doc, unnest(range(1, len(ps) + 1)) AS p, unnest(ps) AS piece FROM texts
), split AS (
    SELECT lang, doc, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), words AS (
    SELECT lang, doc, p, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w1 FROM split
), three AS (
    SELECT lang, w1, lead(w1, 1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3 FROM words
    WINDOW piece AS (PARTITION BY lang, doc, p ORDER BY i)
), grams AS (
    SELECT lang, 1 AS k, w1, NULL AS w2, NULL AS w3 FROM three
    UNION ALL SELECT lang, 2, w1, w2, NULL FROM three WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1, w2, w3 FROM three WHERE w3 IS NOT NULL
), counts AS (
    SELECT lang, k, concat_ws(' ', w1, w2, w3) AS phrase, w1, w2, w3, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY 1
), candidates AS (
    SELECT * FROM counts WHERE k > 1 AND f >= 10
), parts AS (
    SELECT lang, k, phrase, f, 1 AS cut, w1 AS before, concat_ws(' ', w2, w3) AS rest FROM candidates
    UNION ALL SELECT lang, k, phrase, f, 2, w1 || ' ' || w2, w3 FROM candidates WHERE k = 3
), cuts AS (
    SELECT c.lang, c.k, c.phrase, c.f AS a, c.cut, x.f AS l, y.f AS r,
           (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
    FROM parts c
    JOIN counts x ON x.lang = c.lang AND x.phrase = c.before
    JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
    SELECT lang, phrase, max(f) AS f FROM (
        SELECT lang, w1 || ' ' || w2 AS phrase, f FROM candidates WHERE k = 3
        UNION ALL SELECT lang, w2 || ' ' || w3, f FROM candidates WHERE k = 3
    ) GROUP BY 1, 2
), kept AS (
    SELECT c.* FROM lowest c LEFT JOIN longer g ON c.k = 2 AND g.lang = c.lang AND g.phrase = c.phrase
    WHERE g.f IS NULL OR 100 * g.f < 50 * c.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
