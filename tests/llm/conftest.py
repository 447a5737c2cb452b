import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns under names that operators use inside
    T.StructField("fp", T.StringType()), T.StructField("_body", T.LongType()), T.StructField("n_words", T.StringType()),
    T.StructField("_runs", T.LongType()), T.StructField("a.b", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples, with clashing extra columns."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1, "y", 2, 3) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, ties, repeated rows, null ids, a long text."""
    words = [f"w{k}" for k in range(60_000)]
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one"), (None, "one two"), (None, None),
            (6, " ".join(words)), (7, " ".join(words[:50_000]) + " end"), (8, "Éa \x0b été\x00 b\x7f <|endoftext|> ½ ٣"),
            (9, "a " * 300), (9, "other text of the same id")]
