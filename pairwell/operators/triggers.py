"""Trigger rows as a relation under two uniqueness rules (TRG1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def query_id(query: Column, should: Column) -> Column:
    """The id of a row that has none: the SHA-256 of [query, polarity] as compact JSON of the text as it is."""
    pair = F.concat(F.lit("["), json_string(query), F.lit(","), should.cast("string"), F.lit("]"))
    return F.concat(F.lit("query-"), F.sha2(pair, 256))


def json_string(text: Column) -> Column:
    """A JSON string with only what JSON has to escape escaped."""
    wrapped = F.to_json(F.struct(text.alias("t")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def validated(rows: DataFrame, source: str = "source", place: str = "row", query: str = "query", should: str = "should_trigger", given: str = "query_id") -> DataFrame:
    """Each row with its id and the first rule that it breaks (null: none).

    A repeated id breaks a rule on every row but the first of it, and says whether the definitions differ; a query that
    differs from an earlier one in white space at its ends alone must have that one's id and polarity. should is a
    boolean that is null where the row's value was none. Both rules are grouped by their own key; only the smallest row of a key is joined back.
    """
    q, s = F.col(query), F.col(should)
    own = F.coalesce(F.nullif(F.col(given), F.lit("")), query_id(q, s))
    shape = (
        F.when(F.coalesce(F.btrim(q), F.lit("")) == "", "query must be a non-empty string")
        .when(s.isNull(), "should_trigger must be true or false")
        .when(F.btrim(own) == "", "query_id must be a non-empty string")
    )
    x = rows.withColumns({"__id": own, "__shape": shape, "__canonical": F.btrim(q)})
    good = x.filter("__shape IS NULL")
    first = lambda key, *what: good.groupBy(source, key).agg(F.min_by(F.struct(F.col(place), *what), F.col(place)).alias(f"__by{key}"))
    ids = first("__id", q.alias("q"), s.alias("s"))
    queries = first("__canonical", F.col("__id").alias("i"), s.alias("s"))
    joined = x.join(ids, [source, "__id"], "left").join(queries, [source, "__canonical"], "left")
    by_id, by_query = F.col("__by__id"), F.col("__by__canonical")
    repeated = F.when(F.col(place) > by_id[place], F.when((by_id.q == q) & (by_id.s == s), "duplicate query_id").otherwise("query_id identifies conflicting queries"))
    alias = F.when((F.col(place) > by_query[place]) & ((by_query.i != F.col("__id")) | (by_query.s != s)), "aliases of one query must share one id and polarity")
    return joined.withColumns({"valid_id": F.col("__id"), "error": F.coalesce(F.col("__shape"), repeated, alias)}).select(*rows.columns, "valid_id", "error")


