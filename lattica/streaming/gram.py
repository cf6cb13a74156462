"""The Gram matrix of a stream of rows: additive, so a streaming aggregation holds it in n (n + 1) / 2 states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_gram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, v) of the upper triangle of XᵀX, for batch and streaming frames (output mode complete or update)."""
    terms = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), (F.col(columns[a]).cast("double") * F.col(columns[b]).cast("double")).alias("v")) for a in range(len(columns)) for b in range(a, len(columns))]
    return rows.select(F.explode(F.array(*terms)).alias("t")).groupBy("t.i", "t.j").agg(F.sum("t.v").alias("v"))
