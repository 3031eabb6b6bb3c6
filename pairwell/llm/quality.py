"""Quality classifier from weak labels.

Heuristic labellers vote junk, good or nothing on every document; each kind of
junk is seen by two or more of them. Their votes form patterns; the patterns'
counts over all documents (hundreds in practice, at most 3**12) are all that expectation-maximisation needs to estimate each labeller's
accuracies and the share of junk, without any gold label. The posterior labels
then train a hashed linear scorer on a bounded sample (SAMPLE documents, by a
hash of the text and id), and every document is scored whole.

Defined cases: a null or blank text has no votes; its pattern's posterior
falls to the scorer like any other, and a text without a word is scored 0;
repeated rows count and score each; an empty table gives no rows; extra
columns are not read by the query and kept by the filter.
"""

from __future__ import annotations

import operator
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm import linear
from pairwell.llm.common import ddl_schema, fresh_name, read_table, record_batch, text_batches

SAMPLE = 6000
#: Labellers are made to call good text junk at most this often.
MOST_FALSE = 0.01
#: The quality filter keeps documents with at least this score.
KEEP_AT = 0.5
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the and of to in is that for it was with as on be at by this from or an are not have "
    "le la les de des du et en un une que qui pour dans est sur par au il ne pas "
    "der die das und in zu den mit von für ist im nicht ein eine auf als auch es dem "
    "el los las y del se por con para su al lo como más pero sus".split()
)
#: Signs that prose uses seldom.
MARKS = "#$%&*@^~<>{}[]|\\=_+"


def statistics(text: str | None) -> dict[str, float]:
    """Shares and lengths of a whole text that the labellers and the scorer look at."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return {}
    codes = linear.code_points(text)
    ascii_codes = codes[codes < 128]
    hits = np.bincount(ascii_codes, minlength=128)
    upper, lower = int(hits[65:91].sum()), int(hits[97:123].sum())
    marks = sum(int(hits[ord(c)]) for c in MARKS)
    lines = [line for line in text.split("\n") if line.strip()]
    return {
        "words": n,
        "word_length": (len(codes) - n) / n,
        "capitals": upper / (upper + lower) if upper + lower >= 20 else 0.0,
        "marks": marks / len(codes),
        "shouts": hits[33] / n,
        "bars": hits[124] / n,
        "odd_signs": int(hits[33:48].sum() + hits[58:65].sum() + hits[91:97].sum() + hits[123:127].sum()) / max(1, len(codes) - n),
        "odd_endings": sum(w[-1] in MARKS for w in words) / n,
        "echo": sum(map(operator.eq, words, words[1:])) / n,
        "far_echo": sum(map(operator.eq, words, words[2:])) / n,
        "variety": len(set(words)) / n,
        "same_lines": 1 - len(set(lines)) / len(lines),
        "lines": len(lines),
        "function_words": sum(map(FUNCTION_WORDS.__contains__, words)) / n,
        "digits": int(hits[48:58].sum()) / len(codes),
    }


def _band(value: float, good_to: float, junk_from: float) -> int:
    return -1 if value >= junk_from else 1 if value <= good_to else 0


#: Each labeller: -1 junk, 1 good, 0 no opinion.
LABELLERS = {
    "marks": lambda s: _band(s["marks"], 0.01, 0.03),
    "odd_signs": lambda s: _band(s["odd_signs"], 0.1, 0.2),
    "odd_endings": lambda s: _band(s["odd_endings"], 0.05, 0.25),
    "capitals": lambda s: _band(s["capitals"], 0.15, 0.4),
    "shouts": lambda s: _band(s["shouts"], 0.05, 0.25),
    "bars": lambda s: _band(s["bars"], 0.02, 0.15),
    "echo": lambda s: _band(s["echo"], 0.1, 0.3),
    "far_echo": lambda s: _band(s["far_echo"], 0.15, 0.3),
    "variety": lambda s: 0 if s["words"] < 30 else _band(1 - s["variety"], 0.6, 0.9),
    "same_lines": lambda s: 0 if s["lines"] < 4 else _band(s["same_lines"], 0.2, 0.6),
    "word_length": lambda s: 0 if s["words"] < 20 else 1 if 3 <= s["word_length"] <= 8 else -1 if s["word_length"] > 14 else 0,
    "digits": lambda s: _band(s["digits"], 0.2, 0.6) if s["words"] >= 5 else 0,
}


def pattern(stats: dict[str, float]) -> int:
    """All votes as one number in base 3."""
    code = 0
    for vote in LABELLERS.values():
        code = code * 3 + (vote(stats) + 1 if stats else 1)
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    """A row of votes for each pattern number."""
    k = len(LABELLERS)
    return np.stack([codes // 3 ** (k - 1 - j) % 3 - 1 for j in range(k)], axis=1)


def expectation_maximisation(
    votes: np.ndarray, counts: np.ndarray, rounds: int = 200, most_false: float = 1.0
) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, P(votes junk | class, votes) by [class, labeller], and the share of good.

    Votes are independent given the class; having no opinion says nothing of it.
    Classes are junk and good. At the start a labeller sees some kinds of junk
    and hardly ever calls good text junk, which tells the classes apart; one
    pseudo-document keeps the estimates inside (0, 1). most_false bounds how often
    a labeller may call good text junk, so that a small kind of junk that several
    labellers see is not taken for a kind of good text.
    """
    junk, fine = (votes == -1).astype(float), (votes == 1).astype(float)
    prob = np.repeat([[0.4], [0.02]], votes.shape[1], axis=1)
    good = 0.8
    posterior = np.full(len(votes), good)
    for _ in range(rounds):
        logs = [np.log(share) + junk @ np.log(p) + fine @ np.log(1 - p) for p, share in zip(prob, (1 - good, good))]
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        for c, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            prob[c] = (weight @ junk + 0.5) / (weight @ (junk + fine) + 1)
        prob[1] = np.minimum(prob[1], most_false)
        good = float((counts @ posterior + 1) / (counts.sum() + 2))
        if np.abs(posterior - before).max() < 1e-9:
            break
    return posterior, prob, good


_EDGES = {
    "capitals": (0.05, 0.15, 0.3, 0.5, 0.8), "marks": (0.003, 0.01, 0.03, 0.1, 0.2), "shouts": (0.02, 0.1, 0.25, 0.5),
    "bars": (0.01, 0.05, 0.15, 0.3), "odd_signs": (0.05, 0.1, 0.2, 0.4), "odd_endings": (0.02, 0.1, 0.25, 0.6), "far_echo": (0.05, 0.15, 0.3, 0.6), "echo": (0.03, 0.1, 0.2, 0.4, 0.7), "variety": (0.05, 0.1, 0.2, 0.4, 0.6),
    "same_lines": (0.05, 0.2, 0.5, 0.8), "word_length": (2, 3, 5, 8, 10, 14), "digits": (0.02, 0.1, 0.2, 0.4),
    "function_words": (0.02, 0.05, 0.1, 0.2), "words": (5, 20, 50, 200, 1000),
}


def features(text: str, stats: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of unit length, and the band of each statistic as a hashed feature."""
    counts = linear.ngram_counts(linear.code_points(text))
    index = np.flatnonzero(counts)
    value = np.log1p(counts[index])
    bands = linear.buckets([0x110000 + i * 16 + np.searchsorted(edges, stats[name]) for i, (name, edges) in enumerate(_EDGES.items())])
    return np.concatenate([index, bands]), np.concatenate([value / np.linalg.norm(value), np.full(len(bands), 0.5)])


def pattern_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Every vote pattern and how many documents have it: at most 3**12 rows."""
    out = ddl_schema("pattern long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in text_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                code = pattern(statistics(text))
                seen[code] = seen.get(code, 0) + 1
        yield record_batch([list(seen), list(seen.values())], out)

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pattern long, n long")
    rows = sorted(found.groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


class Model:
    def __init__(self, weights: np.ndarray, temperature: float) -> None:
        self.weights, self.temperature = weights, temperature

    def score(self, text: str | None) -> float:
        stats = statistics(text)
        if not stats:
            return 0.0
        index, value = features(text, stats)
        logits = value @ self.weights[index] + self.weights[-1]
        return float(linear.softmax(logits / self.temperature)[1])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Votes of all documents, their EM labels, and a scorer fitted on a bounded sample of them."""
    codes, counts = pattern_counts(docs, text_col)
    if not len(codes):
        return Model(np.zeros((linear.BUCKETS + 1, 2), np.float32), 1.0)
    label = dict(zip(codes.tolist(), expectation_maximisation(votes_of(codes), counts, most_false=MOST_FALSE)[0].tolist()))
    out = ddl_schema("model binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in text_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                if stats := statistics(text):
                    index, value = features(text, stats)
                    good = label.get(pattern(stats), 0.5)
                    examples.append((index.astype(np.int32), value.astype(np.float32), np.array([1 - good, good])))
        yield record_batch([[pickle.dumps(linear.fit(examples, 2))]], out)

    span = 1 << 30
    threshold = min(span, span * SAMPLE // int(counts.sum()))
    order = F.xxhash64(id_col, text_col, F.lit("quality sample"))
    one = (
        docs.select(F.col(text_col).alias("text"), order.alias("order"))
        .filter(F.pmod("order", F.lit(span)) < threshold)
        .repartition(1)
        .sortWithinPartitions("order", "text")
        .select("text")
    )
    return Model(*pickle.loads(one.mapInArrow(run, "model binary").first()[0]))


def scorer(spark: SparkSession, model: Model):
    """A column function from text to the probability of good; the model is 2 x BUCKETS numbers."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return score


def keep_good(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that score keep_at or more; all columns stay."""
    score, name = scorer(docs.sparkSession, train(docs)), fresh_name(docs, "quality_score")
    return docs.withColumn(name, score(F.col("text"))).filter(F.col(name) >= keep_at).drop(name)


def op3_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, and whether it is kept."""
    docs = read_table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", scorer(spark, train(docs))(F.col("text")).alias("score"))
    return scored.withColumn("keep", F.col("score") >= KEEP_AT)
