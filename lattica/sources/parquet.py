"""Reading and writing matrices as Parquet. Blocks are partitioned by block row, so a slice reads the folders that it needs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.matrix import Matrix
from lattica.operators.block import SCHEMA, BlockMatrix
from lattica.types import require


def read_entries(spark: SparkSession, path: str, m: int | None = None, n: int | None = None, check: bool = True) -> Matrix:
    """Columns (i, j, v) or (i, j, re, im)."""
    return Matrix.from_entries(spark.read.parquet(path), m, n, check)


def write_entries(a: Matrix, path: str, mode: str = "errorifexists") -> None:
    a.df.write.mode(mode).parquet(path)


def read_rows(spark: SparkSession, path: str, key: str, array: str, n: int, m: int | None = None) -> Matrix:
    """One array cell a row."""
    return Matrix.from_rows(spark.read.parquet(path), key, array, n, m)


def write_rows(a: Matrix, path: str, mode: str = "errorifexists") -> None:
    """(i, a): one cell of n numbers a row; rows without entries are written as zeros."""
    require(not a.complex, "cells hold real numbers")
    found = a.df.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("x"))
    cell = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(a.n - 1).cast("long")), lambda j: F.coalesce(F.col("x")[j], F.lit(0.0))) if a.n else F.array().cast("array<double>")
    rows = a.df.sparkSession.range(a.m).withColumnRenamed("id", "i").join(found, "i", "left")
    rows.select("i", cell.alias("a")).write.mode(mode).parquet(path)


def write_blocks(a: BlockMatrix, path: str, mode: str = "errorifexists") -> None:
    a.df.write.mode(mode).partitionBy("bi").parquet(path)


def read_blocks(spark: SparkSession, path: str, m: int, n: int, block: int, is_complex: bool = False, rows: tuple[int, int] | None = None) -> BlockMatrix:
    """``rows`` reads the block rows of these bounds only."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if rows is not None:
        df = df.where((F.col("bi") >= rows[0]) & (F.col("bi") < rows[1]))
    return BlockMatrix(df.select("bi", "bj", "nr", "nc", "data"), m, n, block, is_complex)
