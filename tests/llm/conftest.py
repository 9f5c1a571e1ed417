import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) tuples, with a column whose name clashes."""

    def of(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None) for r in rows]
        return spark.createDataFrame(full, DOCS).withColumn("kept", F.lit("clash")).withColumn("words", F.lit(1))

    return of


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "word " * 30_000), (6, "Ünï codé \U0001f600 text"), (None, "no id")]
