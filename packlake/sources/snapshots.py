"""Versioned snapshots: a folder of Parquet tables for each version and a pointer to the last.

A version is complete before the pointer names it, so a reader never sees a part of one. All
paths go through Hadoop's file system, so any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES

#: A file in a version's folder that says that all its tables are there.
COMPLETE = "_COMPLETE"

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm, p


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all versions that were begun."""
    fs, jvm, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = (x.getPath().getName() for x in fs.listStatus(p))
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def current_version(spark: SparkSession, root: str) -> int | None:
    """The version that the pointer names; without a pointer the last complete one; None before
    the first one."""
    fs, jvm, p = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(p):
        whole = [v for v in _versions(spark, root) if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/v={v}/{COMPLETE}"))]
        return max(whole, default=None)
    stream = fs.open(p)
    try:
        return int(bytes(stream.readAllBytes()).decode().strip())
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, version: int) -> None:
    """Name a version as the current one: mark it as complete, write the pointer aside, then
    rename it over the old one in a single step, so that there always is a pointer."""
    fs, jvm, p = _fs(spark, f"{root}/CURRENT")
    path = jvm.org.apache.hadoop.fs.Path
    fs.create(path(f"{root}/v={version}/{COMPLETE}"), True).close()
    aside = path(f"{root}/CURRENT.{version}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(str(version).encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(aside), fs.makeQualified(p), how)


def save(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> int:
    """Write a version, then publish it; extents are sorted so that scans prune by file. The
    number is one that no version, complete or not, has had: nothing is written over."""
    version = max([current_version(spark, root) or 0, *_versions(spark, root)]) + 1
    for name, df in tables.items():
        if name == "extents":
            df = df.sortWithinPartitions("ino", "file_offset")
        df.write.mode("error").parquet(f"{root}/v={version}/{name}")
    publish(spark, root, version)
    return version


def load(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """Tables of a version, or of the current one; an error if there is none."""
    version = version if version is not None else current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no snapshot at {root}")
    fs, jvm, _ = _fs(spark, root)
    out = {}
    for name, schema in TABLES.items():
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/v={version}/{name}")):
            out[name] = spark.read.schema(schema).parquet(f"{root}/v={version}/{name}")
    return out


def load_extra(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame | None:
    """A table beside the state's own in the current version; None if it has none."""
    version = current_version(spark, root)
    fs, jvm, _ = _fs(spark, root)
    path = f"{root}/v={version}/{name}"
    return spark.read.schema(schema).parquet(path) if version is not None and fs.exists(jvm.org.apache.hadoop.fs.Path(path)) else None


def load_or_empty(spark: SparkSession, *roots: str) -> dict[str, DataFrame]:
    """The first snapshot among roots (a local copy, then the store), or the tables of a new
    file system, which hold a root directory and nothing else."""
    for root in roots:
        if current_version(spark, root) is not None:
            return load(spark, root)
    return new_tables(spark)


def new_tables(spark: SparkSession, block: int = 4096) -> dict[str, DataFrame]:
    root = [(1, 0o040000, 0o755, 1, 0, 0, 0, 0, 0, 0, block, 0, 0)]
    return {name: spark.createDataFrame(root if name == "inodes" else [], schema) for name, schema in TABLES.items()}


def drop_version(spark: SparkSession, root: str, version: int) -> None:
    """Remove a staged or old version; never the current one."""
    if version == current_version(spark, root):
        raise ValueError("the current version stays")
    fs, jvm, _ = _fs(spark, root)
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/v={version}"), True)


def difference(before: DataFrame, after: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one side only, with `side` (removed or added); multiset semantics."""
    a, b = before.drop(*ignore), after.drop(*ignore).select(*before.drop(*ignore).columns)
    return a.exceptAll(b).withColumn("side", F.lit("removed")).unionAll(b.exceptAll(a).withColumn("side", F.lit("added")))


def is_dirty(before: DataFrame, after: DataFrame) -> bool:
    """Whether anything changed: a local copy is behind."""
    return not difference(before, after).isEmpty()


def is_structurally_dirty(before: DataFrame, after: DataFrame) -> bool:
    """Whether anything but access times changed: the store is behind."""
    return not difference(before, after, ("atime_ns",)).isEmpty()
