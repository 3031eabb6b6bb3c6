"""Periodic runs of words: Main and Lorentz's divide and conquer.

Words are interned to numbers. A stretch is cut at its midpoint; two
Z-functions give, for every period, how far the words beside the midpoint
agree with those one period on, to the left and to the right, and so every
repetition that crosses it. Both halves follow. A repetition that the edge of
its stretch cuts off is part of one that an outer midpoint has found, so it
is dropped; of those with one interval the smallest period stays. A run of
least length 12 holds two equal six-word grams, so stretches without such a
pair are passed over.

Defined cases: a null text has no words; rows without an id are not altered,
for their hash is not defined; ties of length go to the smallest start, then
period; repeated rows stay repeated; very long texts are one row's work and
take memory for some twenty numbers a word; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.common import ddl_schema, read_table, record_batch, text_batches

#: Fixed: a run has this many words at least, and twice its period.
LEAST = 12
#: Positions a period apart that agree in a run: LEAST minus the period or the period, whichever is more; at least 6.
GRAM = LEAST // 2
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd factors of the gram hash, from the fractional part of the golden ratio.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, GRAM + 1)], np.uint64)


def altered(words: list[str], doc_id: int | None) -> list[str]:
    """The words of one document in ten with a period laid over their end; the choice is by the id's CRC-32."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def interned(words: list[str]) -> np.ndarray:
    """A number for each distinct word, in order of first sight."""
    numbers: dict[str, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def next_grams(ids: np.ndarray) -> np.ndarray:
    """For each gram the start of the next one with its hash, len(ids) where there is none."""
    n = len(ids)
    if n <= GRAM:
        return np.full(n, n)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    m = n - GRAM + 1
    hashes = sum(mixed[k : k + m] * FACTORS[k] for k in range(GRAM))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.full(n, n)
    out[order[:-1][same]] = order[1:][same]
    return out


def z_function(s: list[int], upto: int) -> np.ndarray:
    """How long the prefix of s is that begins at each of the first `upto` places."""
    n, z, left, right = len(s), [0] * upto, 0, 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    z[0] = n
    return np.array(z, np.int64)


def crossing(ids: list[int], low: int, mid: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the repetitions of LEAST words in [low, high) that hold a whole period on one side of mid."""
    u, v = ids[low:mid], ids[mid:high]
    nu, nv = len(u), len(v)
    forward = z_function([*v, -1, *u, *v], nv + 1 + nu)
    back_u, back_v = u[::-1], v[::-1]
    backward = z_function([*back_u, -1, *back_v, *back_u], nu + 1 + nv)
    # a whole period on the right: words beside mid against those q on
    q = np.arange(1, nv)
    to_right, to_left = forward[q], backward[nu + 1 + nv - q]
    right = (q, mid - to_left, mid + q + to_right)
    # a whole period on the left: words beside mid against those q before
    q = np.arange(1, nu)
    to_left, to_right = backward[q], forward[nv + 1 + nu - q]
    left = (q, mid - q - to_left, mid + to_right)
    # the period as long as the side itself has no word left to compare there
    whole = [(np.array([nv]), mid - backward[nu + 1 : nu + 2], np.array([high]))] if nv else []
    whole += [(np.array([nu]), np.array([low]), mid + forward[nv + 1 : nv + 2])] if nu else []
    q, start, end = (np.concatenate(x) for x in zip(right, left, *whole))
    good = (end - start >= 2 * q) & (end - start >= LEAST)
    return start[good], end[good], q[good]


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n = len(ids)
    following, words = next_grams(ids), ids.tolist()
    found: dict[tuple[int, int], int] = {}
    work = [(0, n)] if n >= LEAST else []
    while work:
        low, high = work.pop()
        if int(following[low:high].min()) > high - GRAM:
            continue
        mid = (low + high) // 2
        for start, end, q in zip(*(x.tolist() for x in crossing(words, low, mid, high))):
            cut = (start == low > 0 and words[low - 1] == words[low - 1 + q]) or (end == high < n and words[high] == words[high - q])
            if not cut:
                found[start, end] = min(q, found.get((start, end), n))
        work += [half for half in ((low, mid), (mid, high)) if half[1] - half[0] >= LEAST]
    return sorted((start, end - start, q) for (start, end), q in found.items())


def kept_words(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words but for what each run repeats: its words after the first period go."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    starts, lengths, periods = np.array(found).T
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    return [w for w, deep in zip(words, np.cumsum(change).tolist()) if not deep]


FOUND = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, runs_sha256 string, collapsed_sha256 string"
)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter: bool = False) -> DataFrame:
    """Per row: the number of runs, the longest one, digests of all runs and of the text without the repetitions.

    alter: lay a known period over one document in ten first. A map over the scan, nothing is shuffled.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = ddl_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = WORD.findall(text or "")
                words = altered(words, doc_id) if alter else words
                found = runs(interned(words))
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                left = " ".join(kept_words(words, found))
                rows.append((doc_id, len(words), len(found), *best, _sha(said), _sha(left)))
            yield record_batch(list(zip(*rows)) or [[]] * len(out), out)

    return source.mapInArrow(run, FOUND)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def run_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each run of each text: doc_id, start, length, period (word numbers)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = "doc_id long, start long, length long, period long"
    out = ddl_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            rows = [
                (doc_id, *r)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for r in runs(interned(WORD.findall(text or "")))
            ]
            yield record_batch(list(zip(*rows)) or [[]] * len(out), out)

    return source.mapInArrow(run, ddl)


def op13_main_lorentz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of documents, one in ten with a period laid over its end."""
    found = periodic_runs(read_table(spark, sf_dir, "documents"), alter=True)
    exponent = F.expr("(1000 * length) div period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "start", "length", "period", exponent, "runs_sha256", "collapsed_sha256")
