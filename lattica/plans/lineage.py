"""Cutting the lineage of iterative operators and of factors that are used several times, in the reliable checkpoint folder."""

from __future__ import annotations

import tempfile
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from lattica.matrix import Matrix


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, one JVM alone (``local[...]``) may use a folder of its own; a cluster has none that all can read."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_frame(df: DataFrame) -> DataFrame:
    """Compute once and forget how, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut(a: Matrix) -> Matrix:
    return replace(a, df=cut_frame(a.df))
