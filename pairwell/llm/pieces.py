"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary and its merge scores come from a public model file. Pairs wait
on an agenda, best score first; when a pair's turn comes, it is skipped if the
keyed hash of (occurrence, place in the word, merged piece) falls below the rate,
else it is merged if both sides still stand. Rate 0 gives the library's own
ids. No piece spans a border before a space, so words are segmented one by
one. Each occurrence of a word draws its own merges: the hash is keyed by the
seed, the document id and the position.

A worker remembers of a word only what no draw bears on: its plain ids and the
merges that lead to them. The draws of those are made for all words of a batch
at once; where none is skipped the plain ids stand. All other words run through
the agenda side by side, as rows of arrays: each step takes every row's best
pair, draws, and merges or skips it.

Characters without a piece, and the space sign itself where the text has it,
become byte pieces, so every text decodes to itself.

Defined cases: a null or empty text has no ids; rows without an id hash as id
-1; repeated rows have equal ids; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.common import ddl_schema, read_table, record_batch, text_batches
from pairwell.llm.tokens import tokenizer_path

DROPOUT, SEED = 0.1, 7
#: Remembered words, words whose occurrences are counted, how often a word is met before it is remembered, and the characters of the longest one.
CACHE, NOTED, REMEMBER_AT, CACHE_CHARS = 150_000, 300_000, 8, 64
#: Words that go through the agenda side by side.
ROWS = 8192
#: Draws made at once.
PAIRS = 1 << 20
NOTHING = np.empty(0, np.uint64)
#: The rank of a pair that may not be merged, and what stands for a character without a piece and for nothing.
LAST, UNKNOWN, GAP = (1 << 31) - 1, -1, -2
#: Odd multipliers of the keyed hash.
_FIRST, _SECOND = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_ALL = (1 << 64) - 1
#: Fixed by the format: the sign that stands for a space.
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def merge_name(place: int, piece: int) -> int:
    return (place * _FIRST + piece * _SECOND) & _ALL


def draw(salt: int, name: int) -> int:
    """The keyed hash of a merge: a number below 2**64."""
    x = salt ^ name
    x = (x ^ (x >> 33)) * _FIRST & _ALL
    return (x ^ (x >> 29)) * _SECOND & _ALL


def draws(salts: np.ndarray, names: np.ndarray) -> np.ndarray:
    """draw() of each salt and name."""
    x = salts ^ names
    x = (x ^ (x >> np.uint64(33))) * np.uint64(_FIRST)
    return (x ^ (x >> np.uint64(29))) * np.uint64(_SECOND)


def occurrence_salts(key: int, seed: int, count: int) -> np.ndarray:
    """A key for each of the words of a document."""
    return draws(np.arange(count, dtype=np.uint64), np.full(count, xxhash.xxh64_intdigest(b"%d" % key, seed), np.uint64))


class PairTable:
    """Rank and piece of each pair of pieces that is one, in open addressing."""

    def __init__(self, keys: np.ndarray, rank: np.ndarray, piece: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.rank, self.piece = np.full(size + 1, -1, np.int64), np.full(size + 1, LAST, np.int32), np.zeros(size + 1, np.int32)
        rest, at = np.arange(len(keys)), self._home(keys)
        while len(rest):
            free = self.keys[at[rest]] < 0
            first = rest[free][np.unique(at[rest][free], return_index=True)[1]]
            self.keys[at[first]], self.rank[at[first]], self.piece[at[first]] = keys[first], rank[first], piece[first]
            rest = np.setdiff1d(rest, first)
            at[rest] = (at[rest] + (self.keys[at[rest]] != keys[rest])) % size
        self.size = size

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_FIRST)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands; the last place, of rank LAST, for those that are none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._home(keys)
        at[(left < 0) | (right < 0)] = self.size
        seek = np.flatnonzero((self.keys[at] != keys) & (at < self.size))
        while len(seek):
            ended = self.keys[at[seek]] < 0
            at[seek[ended]] = self.size
            seek = seek[~ended]
            at[seek] = (at[seek] + 1) % self.size
            seek = seek[self.keys[at[seek]] != keys[seek]]
        return at


class Pieces:
    """A model file's pieces: merge scores, ids, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte_id = [0] * 256
        self.raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"")
            else:
                self.rank[piece] = (-model.get_score(i), i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("a piece spans words")
        self.literal = array("I", self.bytes_of(SPACE)).tobytes()
        self.known: dict[str, tuple[bytes, np.ndarray]] = {}
        self.noted: dict[str, int] = {}
        single = {p: i for p, (_, i) in self.rank.items() if len(p) == 1}
        if any(c not in single for piece in self.rank for c in piece):
            raise ValueError("a piece has a character that is none")
        self.single = np.full(0x110000, UNKNOWN, np.int32)
        self.single[[ord(c) for c in single]] = list(single.values())
        ranks = {score: k for k, score in enumerate(sorted({score for score, _ in self.rank.values()}))}
        halves = {}
        for piece, (score, i) in self.rank.items():
            for cut in range(1, len(piece)):
                a, b = self.rank.get(piece[:cut]), self.rank.get(piece[cut:])
                if a and b:
                    halves[a[1] << 32 | b[1]] = ranks[score], i
        keys = np.array(sorted(halves), np.int64)
        self.pairs = PairTable(keys, *(np.array([halves[k][j] for k in keys.tolist()], np.int32) for j in (0, 1)))

    def bytes_of(self, text: str) -> list[int]:
        return [self.byte_id[b] for b in text.encode("utf-8", "surrogatepass")]

    def segment(self, chunk: str, salt: int, skip_below: int) -> list[int]:
        """ids of one word; salt keys the hash, skip_below is the dropout rate times 2**64."""
        return self.segment_long(chunk, salt, skip_below)

    def segment_many(self, words: list[str], salts: np.ndarray, skip_below: int) -> list[bytes]:
        """The same for many words, none longer than CACHE_CHARS, as bytes; words of about one length go together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        out: list[bytes] = [b""] * len(words)
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS]
            self._side_by_side([words[i] for i in rows.tolist()], lengths[rows], salts[rows], skip_below, rows.tolist(), out)
        return out

    def _side_by_side(self, words: list[str], lengths: np.ndarray, salts: np.ndarray, skip_below: int, to: list[int], out: list[bytes]) -> None:
        width, find, rank = int(lengths[-1]), self.pairs.find, self.pairs.rank
        columns = np.arange(width + 1, dtype=np.int32)
        parts = np.full((len(words), width + 1), GAP, np.int32)  # a piece stands where its first character does; the last column is beyond all
        parts[columns < lengths[:, None]] = self.single[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        after, before = np.tile(columns + 1, (len(words), 1)), np.tile(columns - 1, (len(words), 1))
        ranks = np.full((len(words), width + 1), LAST, np.int32)
        ranks[:, :-1] = rank[find(parts[:, :-1].ravel(), parts[:, 1:].ravel())].reshape(len(words), width)
        rows, row_salts = np.arange(len(words)), salts
        open_rows = rows
        while len(open_rows):
            best = ranks[open_rows].argmin(1) if len(open_rows) < len(rows) else ranks.argmin(1)
            going = ranks[open_rows, best] < LAST
            if not going.all():
                open_rows, best = open_rows[going], best[going]
                if not len(open_rows):
                    break
            second = after[open_rows, best]
            piece = self.pairs.piece[find(parts[open_rows, best], parts[open_rows, second])]
            r, k = open_rows, best
            if skip_below:
                names = k.astype(np.uint64) * np.uint64(_FIRST) + piece.astype(np.uint64) * np.uint64(_SECOND)
                skipped = draws(row_salts[r], names) <= np.uint64(skip_below - 1)
                ranks[r[skipped], k[skipped]] = LAST
                r, k, second, piece = (x[~skipped] for x in (r, k, second, piece))
            third, first = after[r, second], before[r, k]
            parts[r, k], parts[r, second], ranks[r, second] = piece, GAP, LAST
            after[r, k], before[r, np.minimum(third, width)] = third, k
            ranks[r, k] = rank[find(piece, parts[r, np.minimum(third, width)])]
            has = first >= 0
            ranks[r[has], first[has]] = rank[find(parts[r[has], first[has]], piece[has])]
        held = parts != GAP
        ends = np.cumsum(held.sum(1)).tolist()
        raw = parts[held].astype("<u4").tobytes()
        for i, a, b in zip(to, [0, *ends], ends):
            out[i] = raw[4 * a : 4 * b]
        for row in np.flatnonzero((parts == UNKNOWN).any(1)).tolist():
            ids = []
            for at in np.flatnonzero(held[row]).tolist():
                ids += [int(parts[row, at])] if parts[row, at] >= 0 else self.bytes_of(words[row][at])
            out[to[row]] = array("I", ids).tobytes()

    def segment_long(self, chunk: str, salt: int, skip_below: int, path: list[int] | None = None) -> list[int]:
        """One word by a heap, whose time does not grow with the square of the length; path takes the names of the merges made."""
        whole = self.rank.get(chunk)
        parts: list[str | None] = list(chunk)
        n = len(parts)
        if n == 1 and whole:
            return [whole[1]]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []
        rank = self.rank.get

        def propose(i: int, j: int) -> None:
            merged = parts[i] + parts[j]
            known = rank(merged)
            if known:
                heapq.heappush(agenda, (known[0], i, j, merged))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, merged = heapq.heappop(agenda)
            a, b = parts[i], parts[j]
            if a is None or b is None or right[i] != j or len(a) + len(b) != len(merged) or a + b != merged:
                continue
            if skip_below and draw(salt, merge_name(i, self.rank[merged][1])) < skip_below:
                continue
            if path is not None:
                path.append(merge_name(i, self.rank[merged][1]))
            parts[i], parts[j] = merged, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                propose(left[i], i)
            if right[i] < n:
                propose(i, right[i])
        out: list[int] = []
        for p in parts:
            if p is not None:
                known = rank(p)
                out += [known[1]] if known else self.bytes_of(p)
        return out

    def _word(self, chunk: str | None, times: int) -> tuple[bytes | None, np.ndarray]:
        """Plain ids and the merges on the way to them of a word that is remembered from now on, if it is."""
        if chunk is None:
            return self.literal, NOTHING
        found = self.known.get(chunk)
        if found is None:
            met = self.noted[chunk] = self.noted.get(chunk, 0) + times
            if met < REMEMBER_AT or len(chunk) > CACHE_CHARS:
                return None, NOTHING
            names: list[int] = []
            ids = array("I", self.segment_long(chunk, 0, 0, names)).tobytes()
            found = self.known[chunk] = ids, np.array(names, np.uint64)
            del self.noted[chunk]
        return found

    def _forget(self, words: Iterable[str | None]) -> None:
        """Bounds what is remembered; what the last batch used stays, if that leaves room."""
        if len(self.noted) > NOTED:
            self.noted.clear()
        if len(self.known) > CACHE:
            self.known = {c: self.known[c] for c in words if c in self.known}
            if len(self.known) > CACHE // 2:
                self.known.clear()

    def encode_batch(self, rows: Iterable[tuple[int, str | None]], dropout: float, seed: int) -> list[bytes]:
        """ids of whole texts, given with their keys, as little-endian u32 bytes."""
        chunks: list[str | None] = []
        salts, ends, skip_below = [], [], min(int(dropout * 2**64), 2**64)
        for key, text in rows:
            begin = len(chunks)
            for k, segment in enumerate(text.split(SPACE) if text else ()):
                if k:
                    chunks.append(None)  # a space sign of the text itself
                chunks += _CHUNK.findall((SPACE if k == 0 else "") + segment.replace(" ", SPACE))
            ends.append(len(chunks))
            salts.append(occurrence_salts(key, seed, len(chunks) - begin))
        number: dict[str | None, int] = {}
        of = np.array([number.setdefault(c, len(number)) for c in chunks], np.intp)
        times = np.bincount(of, minlength=len(number)).tolist()
        words = [self._word(c, n) for c, n in zip(number, times)]
        out = [words[i][0] for i in of.tolist()]
        salt = np.concatenate([NOTHING, *salts])
        varied = self._with_skips(of, [w[1] for w in words], salt, skip_below) if skip_below else np.empty(0, np.intp)
        unknown = np.flatnonzero(np.array([w[0] is None for w in words], bool)[of]) if len(of) else np.empty(0, np.intp)
        at = np.union1d(varied, unknown).astype(np.intp)
        long = np.array([len(chunks[i]) > CACHE_CHARS for i in at.tolist()], bool)
        for i, key in zip(at[long].tolist(), salt[at[long]].tolist()):
            out[i] = array("I", self.segment_long(chunks[i], key, skip_below)).tobytes()
        short = at[~long].tolist()
        for i, ids in zip(short, self.segment_many([chunks[i] for i in short], salt[short], skip_below) if short else ()):
            out[i] = ids
        self._forget(number)
        return [b"".join(out[a:b]) for a, b in zip([0, *ends], ends)]

    def _with_skips(self, of: np.ndarray, merges: list[np.ndarray], salt: np.ndarray, skip_below: int) -> np.ndarray:
        """Which words skip a merge on their plain path; the draws are made PAIRS at a time."""
        lengths = np.array([len(m) for m in merges], np.int64)
        begins, names = np.cumsum(lengths) - lengths, np.concatenate([NOTHING, *merges])
        found, at = [], 0
        totals = np.cumsum(lengths[of])
        while at < len(of):
            base = totals[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(totals, base + PAIRS, "right")))
            some = of[at:upto]
            count = lengths[some]
            which = np.repeat(np.arange(len(some)), count)
            place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            drawn = draws(salt[at:upto][which], names[begins[some][which] + place])
            found.append(at + np.unique(which[drawn <= np.uint64(skip_below - 1)]))
            at = upto
        return np.concatenate([np.empty(0, np.intp), *found])

    def encode(self, text: str | None, key: int, dropout: float, seed: int) -> bytes:
        """ids of a whole text as little-endian u32 bytes."""
        return self.encode_batch([(key, text)], dropout, seed)[0]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "surrogatepass")[1:]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of a file, one per worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian u32 bytes) and the text's sha256."""
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    out = ddl_schema("doc_id long, text_sha256 string, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in text_batches(batches, "text", 1 << 20):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            ids = own.encode_batch([(-1 if i is None else i, text) for i, text in rows], dropout, seed)
            yield record_batch([batch.column("doc_id"), batch.column("text_sha256"), ids], out)

    return source.mapInArrow(run, "doc_id long, text_sha256 string, ids binary")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """The columns of `encode` with the decoded text."""
    ddl = "doc_id long, text_sha256 string, ids binary, text string"
    out = ddl_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in text_batches(batches, "ids"):
            texts = [own.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield record_batch([*(batch.column(c) for c in ("doc_id", "text_sha256", "ids")), texts], out)

    return coded.mapInArrow(run, ddl)


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text into ids with merge-dropout, and back."""
    model = tokenizer_path("piece_bpe_32k.model")
    back = decode(encode(read_table(spark, sf_dir, "documents"), model), model)
    decoded = F.sha2(F.col("text").cast("binary"), 256)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        decoded.alias("decoded_sha256"),
        (decoded == F.col("text_sha256")).alias("lossless"),
    )
