import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = " ".join(f"word{k % 977}" for k in range(60_000))
#: (doc_id, text): nulls, empty and blank texts, one very long, repeated rows and ties.
EDGE = [
    (None, "no id but some words here"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "the same text twice"), (5, "the same text twice"),
    (6, "the same text twice"), (7, "12345 !!! ..."), (8, "ein Satz mit Wörtern\n\nund Zeilen\n"), (9, "Line one\nLine one\nLine one"), (10, "😀 emoji \u0000 nul \u3000 wide"), (11, "a" * 20_000),
]
#: Names that operators use inside.
CLASHING = ("fp", "root", "key", "score", "label", "y", "_text", "_key", "_row", "_runs", "held_out", "piece", "sequence_id", "lang_pred", "lang_score", "n_removed", "component_id", "uid", "v", "_y", "sketch", "hits", "start", "length", "_salt", "offset")


def with_clashes(df: DataFrame) -> DataFrame:
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    return with_clashes(df).cache()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 1), (6, None, 1), (None, 1, 1), (7, 0, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
