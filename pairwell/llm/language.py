"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows in one pass that emits
at most BUCKETS sums a task. The classifier is fitted on a bounded sample:
SAMPLE_PER_LANGUAGE training rows of each language, chosen by a hash of their
id. Every label with a training row is learnt; a label with ten sampled rows or
more lends every fifth to the calibration, and the weights are then fitted on
all. A label costs 4 * BUCKETS bytes in the model and 16 * BUCKETS where it is
fitted. Every document is then scored whole. Training rows are those with a
language and an id whose crc32 modulo 4 is not 2.

Defined cases: a null text or one without a letter is `und` with score 0; a
null id never trains and is not held out; a null language never trains;
repeated rows train and score each; without training rows all is `und`; an
empty table gives no rows; extra columns are not read by the query and kept by
the filter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm import linear
from pairwell.llm.common import ddl_schema, fresh_name, read_table, record_batch, text_batches

SAMPLE_PER_LANGUAGE = 1000
UNKNOWN = "und"
#: The language filter keeps documents whose predicted language has at least this probability.
KEEP_AT = 0.5

_LETTER = None


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once a process."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def normal_codes(text: str | None) -> np.ndarray | None:
    """Lower-case code points with everything but letters as a space; None without a letter."""
    if not text:
        return None
    codes = linear.code_points(text.lower())
    letters = _letters()[codes]
    return np.where(letters, codes, np.uint32(32)) if letters.any() else None


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each bucket occurs, over all of them; the last number counts the texts."""
    out = ddl_schema("bucket int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(linear.BUCKETS + 1, np.int64)
        for batch in text_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                codes = normal_codes(text)
                if codes is not None:
                    seen[:-1] += linear.ngram_counts(codes) > 0
                    seen[-1] += 1
        hit = np.flatnonzero(seen)
        yield record_batch([hit, seen[hit]], out)

    sums = np.zeros(linear.BUCKETS + 1, np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS + 1 rows at most
        sums[bucket] = n
    return sums


def inverse(frequencies: np.ndarray) -> np.ndarray:
    return (np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1).astype(np.float32)


def tf_idf(codes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length values of a text."""
    counts = linear.ngram_counts(codes)
    index = np.flatnonzero(counts)
    value = np.log1p(counts[index]) * idf[index]
    return index, value / np.linalg.norm(value)


def _sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str, sizes: dict[str, int]) -> DataFrame:
    """About SAMPLE_PER_LANGUAGE rows of each language, by a hash of the id: text, lang, order and id."""
    span = 1 << 30
    shares = [(lang, min(span, span * SAMPLE_PER_LANGUAGE // n)) for lang, n in sizes.items()]
    share = rows.sparkSession.createDataFrame(shares, "lang string, share long")  # a row per language, as the model has
    draw = F.pmod(F.xxhash64(id_col, F.lit("language sample")), F.lit(span))
    columns = [F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("order"), F.col(id_col).alias("id")]
    chosen = rows.select(*columns, draw.alias("draw")).join(F.broadcast(share), "lang").filter("draw < share")
    return chosen.select("text", "lang", "order", "id")


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float) -> None:
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = normal_codes(text)
        if codes is None or not self.languages:
            return UNKNOWN, 0.0
        index, value = tf_idf(codes, self.idf)
        logits = value @ self.weights[index] + self.weights[-1]
        p = linear.softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the training rows of docs."""
    rows = training_rows(docs, id_col, lang_col)
    counts = rows.groupBy(lang_col).count().collect()  # a row per language
    sizes = {r[0]: r[1] for r in sorted(counts)}
    languages = list(sizes)
    if not languages:
        return Model([], np.zeros(linear.BUCKETS, np.float32), np.zeros((linear.BUCKETS + 1, 0), np.float32), 1.0)
    idf = inverse(document_frequencies(rows.select(F.col(text_col).alias("text"))))
    number = {lang: i for i, lang in enumerate(languages)}
    out = ddl_schema("model binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, labels, targets = [], [], np.eye(len(number))
        for batch in text_batches(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                codes = normal_codes(text)
                if codes is not None:
                    index, value = tf_idf(codes, idf)
                    examples.append((index.astype(np.int32), value.astype(np.float32), targets[number[lang]]))
                    labels.append(number[lang])
        fitted = linear.fit(examples, len(number), held_rows=linear.calibration_rows(labels))
        yield record_batch([[pickle.dumps(fitted)]], out)

    chosen = _sample(rows, id_col, text_col, lang_col, sizes)
    one = chosen.repartition(1).sortWithinPartitions("order", "id", "lang", "text").select("text", "lang")
    weights, t = pickle.loads(one.mapInArrow(run, "model binary").first()[0])
    return Model(languages, idf, weights, t)


def predictor(spark: SparkSession, model: Model):
    """A column function from text to struct<lang, score>; the model is BUCKETS numbers a language."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(t) for t in texts]
        return pd.DataFrame(found, columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    predict = predictor(docs.sparkSession, model)
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.col(text_col)).alias("found")
    )
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def keep_identified(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents whose language is told with probability keep_at or more; all columns stay."""
    predict, name = predictor(docs.sparkSession, train(docs)), fresh_name(docs, "found_language")
    found = docs.withColumn(name, predict(F.col("text")))
    return found.filter((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= keep_at)).drop(name)


def op6_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
