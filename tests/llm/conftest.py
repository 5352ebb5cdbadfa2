import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long words in a very long text " * 4000


@pytest.fixture
def documents(spark):
    """A `documents` table from (doc_id, text, ...) tuples; missing columns are NULL."""

    def make(*rows):
        return spark.createDataFrame(
            [tuple(r) + (None,) * (5 - len(r)) for r in rows], DOC)

    return make


@pytest.fixture
def odd_documents(documents):
    """NULLs in every column, empty and very long texts, ties and repeated rows."""
    return documents(
        (1, "the same words in the same order", "en", "a"), (1, "the same words in the same order"),
        (2, "the same words in the same order", "en", "a", 32), (3, None, None, None, None),
        (None, "no id here", "en", "b"), (4, "", "en", "a", 0), (5, "  \n\t ", None, "a"),
        (6, LONG, "en", "b", len(LONG)), (7, "x" * 50_000, None, "b"), (8, "é日本😀   ñ", "fr"),
        (9, LONG, "en", "b"))


@pytest.fixture
def clashing(odd_documents):
    """The same rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    table = odd_documents
    for name in ("bits", "key", "ids", "decoded", "spans", "score", "host", "line", "page", "row",
                 "fingerprint", "n_words", "items", "toxic", "words", "_range", "_text", "_site",
                 "_site_lines", "site", "lines"):
        table = table.withColumn(name, F.lit("clash"))
    return table


@pytest.fixture
def write(tmp_path):
    """Writes tables into a folder like those of the queries."""

    def make(**tables):
        for name, table in tables.items():
            table.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make
