"""Functions of texts make their rows a few at a time, whatever Spark's batch holds."""

import pyarrow as pa

from pairwell.functions import diff, rows, view


def test_few_values_at_once(monkeypatch):
    monkeypatch.setattr(rows, "SLICE", 3)
    alive = []

    class Slices:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            part = self.values[at : at + n]
            alive.append(len(part))
            return pa.array(part)

    got = rows.by_slices(lambda t: None if t is None else t.upper(), pa.string(), (Slices(["a", None, "", "d", "e", "f", "g"]),))
    assert got.to_pylist() == ["A", None, "", "D", "E", "F", "G"] and alive == [3, 3, 1]
    assert rows.by_slices(str, pa.string(), (pa.array([], pa.string()),)).to_pylist() == []


def test_more_rows_than_a_slice(spark):
    n = 3 * rows.SLICE + 5
    df = spark.createDataFrame([(i, None if i % 50 == 49 else f"é​{i}\nand the end") for i in range(n)], "i long, t string").coalesce(1)
    got = df.select("i", view.folded(df.t).alias("f"), view.normalization(df.t).alias("n"), view.located(df.t, "AND THE").alias("s"), diff.difference(df.t, view.rendered(df.t)).alias("d")).orderBy("i").collect()
    for r in got:
        if r.i % 50 == 49:
            assert r[1:] == (None, None, None, None)
        else:
            at = 3 + len(str(r.i))
            assert r.f == f"é{r.i}\nand the end" and r.n.removed == {"U+200B": 1} and r.n.removed_at == [1] and r.s[:] == (at, at + 7)
            assert (r.d.removed, r.d.added, r.d.hunks) == (1, 1, 1)
