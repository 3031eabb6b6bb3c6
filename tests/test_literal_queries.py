"""CON1 and LEK2 on texts where full case folding, blanks and repeated ids differ from SQL's lower."""

import duckdb
import pytest

import __spark_entry__

TEXTS = [(1, "die Straße und STRASSE"), (2, "the class of SS"), (3, "café İx ΑΣ"), (4, ""), (5, None), (6, "a\tb c"), (7, "da​sh Café ix ας ασ")]
RUBRICS = [(1, "a b c d SS"), (2, "STRASSE"), (3, "Café"), (3, "c"), (4, "ix"), (5, ""), (6, "\t"), (7, None), (8, "ΑΣ"), (9, "dash"), (10, " ")]


@pytest.mark.parametrize("name", ["con1_canary", "lek2_rubric_leak"])
def test_equals_sql(spark, tmp_path, name):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(RUBRICS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    expected = sorted(map(tuple, duck.execute(__spark_entry__.oracle_sql()[name]).fetchall()))
    assert sorted(map(tuple, __spark_entry__.queries()[name](spark, str(tmp_path)).collect())) == expected
