"""Digests of file trees (DIG1): one SHA-256 over all files of a root, streamed in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def tree_digest(files: DataFrame, root: Sequence[str], path: str, content: str) -> DataFrame:
    """tree_sha256 of each root over its files in order of their path's components, each framed as path, NUL, content.

    An empty or repeated path gives no digest but a problem. The rows of a root meet in one partition, sorted by
    Spark, and are hashed as they pass, so no root is held; the hash itself allows no second task for one root.
    """
    keyed = files.select(*root, F.coalesce(F.col(path), F.lit("")).alias("__path"), F.col(content).cast("binary").alias("__content"))
    keyed = keyed.withColumn("__parts", F.split("__path", "/", -1))
    ordered = keyed.repartition(*root).sortWithinPartitions(*root, "__parts").drop("__parts")
    kinds = StructType([*(ordered.schema[c] for c in root), *StructType.fromDDL("files long, tree_sha256 string, problem string").fields])
    out, n = to_arrow_schema(kinds), len(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, count, before, problem = None, None, 0, None, None
        row = lambda: (*group, count, None if problem else state.hexdigest(), problem)
        for batch in batches:
            rows = []
            for *key, name, data in zip(*(c.to_pylist() for c in batch.columns)):
                if tuple(key) != group:
                    rows += [row()] if group is not None else []
                    group, state, count, before, problem = tuple(key), hashlib.sha256(), 0, None, None
                if not name:
                    problem = "empty path"
                elif name == before:
                    problem = problem or "repeated path"
                state.update(name.encode("utf-8", "surrogatepass") + b"\0")
                state.update(data or b"")
                count, before = count + 1, name
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
        if group is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), out)], schema=out)

    return ordered.select(*root, "__path", "__content").mapInArrow(run, kinds)
