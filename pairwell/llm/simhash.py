"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has a bit where over half of the shingle hashes have it.
Fingerprints are cut into 8 segments of 8 bits on a ring. If two of them
differ in at most 4 bits, then some segment starts a chain in which every
prefix of l segments differs in at most l/2 bits (rounded down). So the first
segment of that chain agrees, one of the next two does, and two of the next
four do: the chain of five fixes 24 bits in one of 5 ways. The 8 starts times
5 ways are the index keys; inside a key, the cumulative budgets along the chain
prune candidates segment by segment, and the last budget is the full check.

Distinct fingerprints are indexed, not documents, so copies cost nothing. In a
key, a search from the first fingerprint takes out all it reaches before the
next begins: it yields a spanning forest, at most one link a member, instead
of all pairs. A link that a start's budgets refuse is found at another start.
Keys with more than DENSE members are keyed again by the chain of seven, which
fixes 32 bits in 14 ways; if one has as many even then, its members are cut into
blocks of about DENSE, and each two blocks are searched together in a task of
their own.

Defined cases: a null or blank text has fingerprint zero; fewer words than a
shingle give one shingle; rows without an id take part and get the smallest id
of their component, null if it has none; repeated rows stay; an empty table
gives no rows; extra columns are not read.

The pipeline's stage (`keep_one`) has another task: every pair of texts whose
sets of five-word shingles have a Jaccard similarity of SIMILAR or more. Bits
of a fingerprint cannot promise that, so its links are only a start there. Two
sets that similar share one of the first shingles (any fixed order, rare ones
first) of each, as many as the larger may lack and one more. Every member of
such a shingle is linked to one member of about its size, the one that shares
most with others; then all pairs that are still in different components are
listed. Sizes, places of the shared shingle and parity sketches, whose
difference never exceeds that of the sets, rule out most pairs; the others are
compared as whole sets, for which their texts travel as zstd frames. No pair is
left out, and a large group costs a star, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.common import ddl_schema, fresh_name, materialize, read_table, record_batch, text_batches
from pairwell.llm.components import connected_components

WORDS, BITS, SEED = 4, 4, 42
#: Words of a shingle where no contract fixes them.
STAGE_WORDS = 5
#: Least Jaccard similarity of near-copies in the pipeline's stage, as a fraction.
SIMILAR = (4, 5)
#: Texts counted, and most shingles kept, to tell frequent shingles; both bear on speed alone.
ORDER_SAMPLE, ORDER_MOST = 20_000, 1 << 16
#: Buckets of a set's sketch, the ratio of sizes in a band (similar sets are in one band or in two next to each other), and shingles a worker remembers.
SKETCH_BITS, BAND, REMEMBERED = 1024, 1.26, 4_000_000
SEGMENTS, SEGMENT_BITS = 8, 8
DENSE = 20_000
#: Bits of a key for the number of its set and, above them and the agreeing segments, for either block.
SET_BITS, BLOCK_BITS = 7, 12


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every word shingle, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not tokens:
        return np.empty(0, np.uint64)
    joined, k = b" ".join(tokens), min(words, len(tokens))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    totals = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        some = hashes[at : at + (1 << 16)]
        totals += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * totals > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every whole text."""
    out = ddl_schema("doc_id long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            fps = np.array([simhash(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()], np.uint64)
            yield record_batch([batch.column("doc_id"), fps.view(np.int64)], out)

    return docs.mapInArrow(run, "doc_id long, fp long")


def _ways(length: int) -> list[tuple[int, ...]]:
    """Segments after the first that agree, so that every chain up to `length` keeps its budget.

    A chain of l segments may differ in l // 2; `length` is odd, so its last
    budget leaves (length - 1) / 2 of its segments equal besides the first.
    """
    agree = (length - 1) // 2
    return [
        w
        for w in combinations(range(1, length), agree)
        if all(n - sum(1 for s in w if s <= n) <= (n + 1) // 2 for n in range(1, length))
    ]


def segment_sets(length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(start, agreeing segments) of every key of the chain's index."""
    return [(i, (i, *((i + s) % SEGMENTS for s in w))) for i in range(SEGMENTS) for w in _ways(length)]


def key_column(number: int, segments: tuple[int, ...], fp: str = "fp") -> Column:
    """The agreeing bits and the number of the key's set in one long."""
    key = F.lit(number).cast("long")
    for s in segments:
        bits = F.shiftrightunsigned(F.col(fp), s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
        key = F.shiftleft(key, SEGMENT_BITS).bitwiseOR(bits)
    return key


def _keyed(nodes: DataFrame, length: int) -> DataFrame:
    sets = segment_sets(length)
    keys = F.array(*[key_column(k, segments) for k, (_, segments) in enumerate(sets)])
    return nodes.select("fp", F.explode(keys).alias("key"))


_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def within_chain(diff: np.ndarray, start: int) -> np.ndarray:
    """Which differences keep the budget of every chain prefix from `start`; few reach the later segments."""
    alive = np.arange(len(diff))
    spent = np.zeros(len(diff), np.uint8)
    for l in range(1, SEGMENTS + 1):  # noqa: E741
        shift = np.uint64((start + l - 1) % SEGMENTS * SEGMENT_BITS)
        spent = spent + _POPCOUNT[((diff[alive] >> shift) & np.uint64(255)).astype(np.intp)]
        keep = spent <= l * BITS // SEGMENTS
        alive, spent = alive[keep], spent[keep]
    return alive


def forest(members: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that join the members as all links within the chain's budgets from `start` would."""
    links, rest = [], np.unique(members)
    queue: list[np.uint64] = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        one = queue.pop()
        near = within_chain(rest ^ one, start)
        if len(near):
            found = rest[near]
            links.extend((int(one), int(x)) for x in found)
            queue.extend(found)
            rest = np.delete(rest, near)
    return links


def _links(keyed: DataFrame, length: int) -> DataFrame:
    """Streams rows sorted by key and searches each key's members."""
    starts = [i for i, _ in segment_sets(length)]
    shift, mask = SEGMENT_BITS * len(segment_sets(length)[0][1]), (1 << SET_BITS) - 1
    out = ddl_schema("u long, v long")

    def search(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        begins, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
        found, sizes = [], ends - begins
        pairs = begins[sizes == 2]  # most keys with company have two members: all at once by start
        of = np.array(starts)[keys[pairs] >> shift & mask]
        for start in np.unique(of).tolist():
            at = pairs[of == start]
            at = at[within_chain(fps[at] ^ fps[at + 1], start)]
            found += zip(fps[at].tolist(), fps[at + 1].tolist())
        for a, b in zip(begins[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            found += forest(fps[a:b], starts[int(keys[a]) >> shift & mask])
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit(final: bool) -> pa.RecordBatch | None:
            keys, fps = (np.concatenate(x) for x in zip(*held))
            last = len(keys) if final else int(np.searchsorted(keys, keys[-1]))
            held[:] = [(keys[last:], fps[last:])]
            found = search(keys[:last], fps[:last]) if last else []
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return record_batch([ends[:, 0], ends[:, 1]], out)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
                if held[0][0].size == 0 or held[0][0][0] != held[-1][0][-1]:
                    yield emit(False)
        if held:
            yield emit(True)

    parts = keyed.repartition("key").sortWithinPartitions("key")
    return parts.mapInArrow(run, "u long, v long")


def _in_blocks(keyed: DataFrame) -> DataFrame:
    """Members of keys of seven segments; those of a crowded key once for each pair of blocks that holds them.

    Any two members are in one block or in two, so some pair of blocks holds both: no link is lost.
    """
    most = (1 << BLOCK_BITS) - 1
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > DENSE)
    crowded = crowded.select("key", F.least(F.ceil(F.col("n") / DENSE), F.lit(most)).cast("int").alias("blocks"))
    marked = keyed.join(crowded, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("long")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda o: o != own)
    pairs = F.transform(others, lambda o: F.shiftleft(F.least(own, o), BLOCK_BITS).bitwiseOR(F.greatest(own, o)))
    pair = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))
    used = SET_BITS + 4 * SEGMENT_BITS
    return marked.select("fp", "key", pair.alias("pair")).select("fp", F.shiftleft("pair", used).bitwiseOR(F.col("key")).alias("key"))


def links(nodes: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (column fp) that join whatever is within 4 bits."""
    keyed = _keyed(nodes, 5)
    dense = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > DENSE).select("key"), "dense-keys")
    if dense.isEmpty():
        return _links(keyed, 5).distinct()
    again = _in_blocks(_keyed(keyed.join(dense, "key", "left_semi").select("fp").distinct(), 7))
    return _links(keyed.join(dense, "key", "left_anti"), 5).union(_links(again, 7)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id (the smallest id of the component) and the component's label, a fingerprint."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(fingerprints(source, words), "simhash")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    labels = connected_components(links(classes.select("fp")))
    labelled = classes.join(labels, classes["fp"] == labels["node"], "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")
    )
    firsts = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_class = labelled.select("fp", "label").join(firsts, "label")
    return rows.join(of_class, "fp").select("doc_id", "fp", "component_id", "label")


def shingle_set(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def prefix(shingles: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set, frequent ones (sorted, in `often`) last: enough that a similar set has one of its own first ones there."""
    num, den = SIMILAR
    few = np.isin(shingles, often, assume_unique=True)
    ordered = np.concatenate([shingles[~few], shingles[few]])
    n = len(ordered)
    return ordered[: n - -(-num * n // den) + 1]


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether each of SKETCH_BITS buckets holds an odd number of the shingles, as longs.

    Every bucket in which two sketches differ holds a shingle that one set has
    alone, so their difference never exceeds that of the sets.
    """
    odd = np.bincount((shingles >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.intp), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many of some ORDER_SAMPLE texts have."""
    span, n = 1 << 30, max(1, docs.count())
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("shingle order")), F.lit(span))
    some = docs.filter(draw < min(span, span * ORDER_SAMPLE // n))
    out = ddl_schema("s long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                yield record_batch([shingle_set(text, words).view(np.int64)], out)

    counts = some.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n"))
    found = counts.filter("n > 2").orderBy(F.desc("n"), "s").limit(ORDER_MOST).collect()
    return np.sort(np.array([r.s for r in found], np.int64).view(np.uint64))


def _profiles(rows: DataFrame, words: int) -> DataFrame:
    """id, doc_id, a hash of the text, the fingerprint, and of the set: digest, size, first shingles and sketch."""
    ddl = "id long, doc_id long, text_hash long, fp long, digest binary, n int, first array<long>, sketch array<long>"
    out, often = ddl_schema(ddl), _frequent(rows, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            fps, digests, sizes, firsts, sketches = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, words)
                own = np.unique(hashes)
                fps.append(simhash(hashes))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                firsts.append(prefix(own, often).view(np.int64) if len(own) else [])
                sketches.append(parity_sketch(own))
            fp = np.array(fps, np.uint64).view(np.int64)
            known = [batch.column(c) for c in ("id", "doc_id", "text_hash")]
            yield record_batch([*known, fp, digests, sizes, firsts, sketches], out)

    numbered = rows.select(F.monotonically_increasing_id().alias("id"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return numbered.mapInArrow(run, ddl)


def _packed(rows: DataFrame) -> DataFrame:
    """id and the text as a zstd frame."""
    out = ddl_schema("id long, frame binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in text_batches(batches, "text"):
            frames = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield record_batch([batch.column("id"), frames], out)

    return rows.select("id", "text").mapInArrow(run, "id long, frame binary")


def _frames(pairs: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """id and packed text of the nodes in pairs, and of no others: what is shuffled later follows the pairs."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    wanted = materialize(nodes.select("id", "doc_id", "text_hash").join(ids, "id", "left_semi"), "wanted-texts")
    own = source.withColumn("text_hash", F.xxhash64("text")).alias("s")
    same_row = F.expr("s.doc_id <=> w.doc_id AND s.text_hash = w.text_hash")
    return materialize(_packed(own.join(wanted.alias("w"), same_row).select("w.id", "s.text")), "text-frames")


def _similar(pairs: DataFrame, frames: DataFrame, words: int) -> DataFrame:
    """The pairs (u, v) of ids whose whole sets are similar; sets of recent texts are remembered, REMEMBERED shingles of them."""
    num, den = SIMILAR
    out = ddl_schema("u long, v long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            found = []
            columns = [batch.column(c) for c in ("u", "v", "of_u", "of_v")]
            for row in zip(*columns):
                sets = []
                for i, frame in ((row[0].as_py(), row[2]), (row[1].as_py(), row[3])):
                    own = known.get(i)
                    if own is None:
                        own = shingle_set(unpack(frame.as_py()).decode("utf-8", "surrogatepass"), words)
                        if held > REMEMBERED:
                            known.clear()
                            held = 0
                        known[i] = own
                        held += len(own)
                    sets.append(own)
                both = len(np.intersect1d(*sets, assume_unique=True))
                if (num + den) * both >= num * (len(sets[0]) + len(sets[1])):
                    found.append((row[0].as_py(), row[1].as_py()))
            yield record_batch(list(zip(*found)) or [[], []], out)

    u, v = (frames.select(F.col("id").alias(c), F.col("frame").alias(f"of_{c}")) for c in "uv")
    return pairs.join(u, "u").join(v, "v").select("u", "v", "of_u", "of_v").mapInArrow(run, "u long, v long")


def _sizes_allow(n: Column, m: Column) -> Column:
    num, den = SIMILAR
    return den * F.least(n, m) >= num * F.greatest(n, m)


def _rest_allows(n: Column, pos_n: Column, m: Column, pos_m: Column) -> Column:
    """False only where what is left of both sets from the first shared shingle on rules it out."""
    num, den = SIMILAR
    return (num + den) * F.least(n - pos_n, m - pos_m) >= num * (n + m)


def _sketches_allow(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sizes and sketches leave room for a similarity of SIMILAR: those differ in at most a share of both sizes."""
    num, den = SIMILAR
    u, v = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_s")) for c in "uv")
    longs = range(SKETCH_BITS // 64)
    differ = sum((F.bit_count(F.col("u_s")[i].bitwiseXOR(F.col("v_s")[i])) for i in longs), F.lit(0))
    allowed = (num + den) * differ <= (den - num) * (F.col("u_n") + F.col("v_n"))
    return pairs.join(u, "u").join(v, "v").filter(_sizes_allow(F.col("u_n"), F.col("v_n")) & allowed).select("u", "v")


def _undirected(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _stars(shared: DataFrame) -> DataFrame:
    """Pairs that link each member of a shared shingle to the member of about its size that shares most with others."""
    weight = shared.groupBy("id").agg(F.sum(F.col("of_key") - 1).alias("weight"))
    best = F.max(F.struct("weight", F.negative("id").alias("least"), "n", "pos")).alias("head")
    heads = shared.join(weight, "id").groupBy("key", "band").agg(best)
    near = shared.select("key", "id", "n", "pos", F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    n, pos, m, pos_m = F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos")
    linked = near.join(heads, ["key", "band"]).filter(_sizes_allow(n, m) & _rest_allows(n, pos, m, pos_m))
    return linked.select(F.col("id").alias("u"), (-F.col("head.least")).alias("v")).filter("u <> v")


def _open_pairs(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs that share a first shingle and have different labels, but for those that sizes and places rule out."""
    labelled = shared.join(labels, shared["id"] == labels["node"], "left").withColumn("label", F.coalesce("label", "id"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    rows = materialize(labelled.join(mixed.select("key"), "key").select("key", "band", "id", "n", "pos", "label"), "open-shingles")
    one = rows.select("key", *(F.col(c).alias(f"a_{c}") for c in ("band", "id", "n", "pos", "label")))
    one = one.withColumn("band", F.explode(F.array("a_band", F.col("a_band") + 1)))
    apart = (F.col("a_label") != F.col("label")) & ((F.col("a_band") < F.col("band")) | (F.col("a_id") < F.col("id")))
    fits = _sizes_allow(F.col("a_n"), F.col("n")) & _rest_allows(F.col("a_n"), F.col("a_pos"), F.col("n"), F.col("pos"))
    found = one.join(rows, ["key", "band"]).filter(apart & fits)
    return found.select(F.col("a_id").alias("u"), F.col("id").alias("v"))


def similar_groups(docs: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """doc_id and component_id, the smallest id of the component of texts at least SIMILAR, of every row."""
    return _grouped(docs, words).select("doc_id", F.col("keeper.doc_id").alias("component_id"))


def _grouped(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and keeper of every row: struct(doc_id, text_hash) of its component's row with the smallest id, of equal ids the smallest hash."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    profiles = materialize(_profiles(source, words), "profiles")
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    classes = materialize(profiles.groupBy("digest").agg(F.min("id").alias("id"), F.min(row).alias("first_row")), "set-classes")
    nodes = materialize(profiles.drop("digest").join(classes.select("id"), "id", "left_semi"), "set-nodes")

    postings = nodes.select("id", "n", F.posexplode("first").alias("pos", "key"))
    keys = materialize(postings.groupBy("key").agg(F.count("*").alias("of_key")).filter("of_key > 1"), "shared-keys")
    band = F.floor(F.log("n") / F.lit(np.log(BAND))).cast("int").alias("band")
    shared = materialize(postings.join(keys, "key").select("key", band, "id", "n", "pos", "of_key"), "shared-shingles")

    firsts = materialize(nodes.groupBy("fp").agg(F.min("id").alias("of_fp")), "first-of-fingerprint")
    near = links(firsts.select("fp"))
    for c in "uv":
        near = near.join(firsts.select(F.col("fp").alias(c), F.col("of_fp").alias(f"{c}_id")), c)
    same_fp = nodes.select("fp", "id").join(firsts, "fp").filter("id <> of_fp").select("id", "of_fp")
    tried = _undirected(_stars(shared).union(near.select("u_id", "v_id")).union(same_fp))
    tried = materialize(_sketches_allow(tried, nodes), "tried-pairs")

    labels = materialize(connected_components(_similar(tried, _frames(tried, nodes, source), words)), "star-labels")

    apart = materialize(_sketches_allow(_open_pairs(shared, labels).distinct(), nodes), "open-pairs")
    found = _similar(apart, _frames(apart, nodes, source), words)
    for c in "uv":
        of = labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        found = found.join(of, c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    joined = connected_components(found.select(F.col("u_label").alias("u"), F.col("v_label").alias("v")))
    outer = joined.select(F.col("node").alias("label"), F.col("label").alias("outer"))

    merged = classes.join(labels, classes["id"] == labels["node"], "left").withColumn("label", F.coalesce("label", "id"))
    merged = merged.join(outer, "label", "left").select("digest", "first_row", F.coalesce("outer", "label").alias("label"))
    least = merged.groupBy("label").agg(F.min("first_row").alias("keeper"))
    return profiles.select("doc_id", "digest").join(merged.select("digest", "label"), "digest").join(least, "label").select("doc_id", "keeper")


def keep_one(docs: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """One document of each component of near-copies stays, the one with the smallest id; all columns stay.

    A row is its id and its text: other texts under a kept id are judged by their own component, of rows with equal id
    and text one stays. Rows without an id stay: nothing names them.
    """
    own, of = fresh_name(docs, "text_hash"), fresh_name(docs, "keeper")
    keepers = _grouped(docs, words).select(F.col("keeper").alias(of)).filter(F.col(of).isNotNull()).distinct()
    hashed = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    same = (hashed["doc_id"].cast("long") == F.col(f"{of}.doc_id")) & (hashed[own] == F.col(f"{of}.text_hash"))
    kept = hashed.join(keepers, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def op1_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
