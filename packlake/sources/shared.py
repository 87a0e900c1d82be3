"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the session names. Without one, a folder of this machine's is taken if
    driver and executors are one process, else it is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        where = tempfile.mkdtemp(prefix="ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """`df` computed once, in the shared folder: lineage is cut, and a lost executor costs
    nothing but the read."""
    folder(df.sparkSession)
    return df.checkpoint()
