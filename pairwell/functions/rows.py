"""Arrow functions of whole texts that hold Python objects of a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows whose Python values live at once; a batch of Spark's is 10,000 rows, whatever their length.
SLICE = 64


def by_slices(one: Callable, kind: pa.DataType, columns: tuple[pa.Array, ...]) -> pa.Array:
    """one of each row's values, SLICE rows at a time; structs are given as dicts, maps as lists of pairs."""
    parts = []
    for at in range(0, len(columns[0]), SLICE):
        values = zip(*(c.slice(at, SLICE).to_pylist() for c in columns))
        parts.append(pa.array([one(*v) for v in values], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def of_text(returns: T.DataType, one: Callable) -> Callable:
    """An Arrow function of a column of texts."""
    kind = to_arrow_type(returns)

    @F.arrow_udf(returns)
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(one, kind, (texts,))

    return run


def of_two_texts(returns: T.DataType, one: Callable) -> Callable:
    """An Arrow function of two columns of texts."""
    kind = to_arrow_type(returns)

    @F.arrow_udf(returns)
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return by_slices(one, kind, (left, right))

    return run
