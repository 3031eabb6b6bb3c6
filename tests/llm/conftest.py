import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and awkward characters."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here "
    return [
        (7, base * 3), (3, base * 3), (11, None), (5, ""), (9, "  \n\t "), (2, "é"), (4, "é"), (13, "x" * 70_000 + " end"),
        (21, base.upper() * 3), (22, "漢字かな交じり文"), (23, "a\u0000b\r\nWARC/1.1\r\n"), (None, "no id"), (None, None), (7, base * 3), (40, "🙂 ok"), (41, "Straße STRASSE"),
    ]
