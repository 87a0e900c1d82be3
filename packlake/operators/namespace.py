"""Lookups and listings over the file namespace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blocks512, full_mode, ns_rest, ns_seconds
from ..schema import ROOT_INO, S_IFDIR, S_IFLNK, S_IFREG
from ..sources.shared import stored


def get_inode(inodes: DataFrame, ino: int) -> DataFrame:
    """A point lookup; reaches the scan as a pushed filter."""
    return inodes.where(F.col("ino") == ino)


def lookup(entries: DataFrame, parent: int, name: str) -> DataFrame:
    return entries.where((F.col("parent_ino") == parent) & (F.col("name") == name)).select("child_ino")


def stat(inodes: DataFrame) -> DataFrame:
    """ino, full mode, size, blocks, blksize and the modification time in two parts."""
    return inodes.select(
        "ino",
        full_mode("file_type", "mode").cast("int").alias("full_mode"),
        "size",
        blocks512("size").alias("blocks"),
        "blksize",
        ns_seconds("mtime_ns").alias("mtime_sec"),
        ns_rest("mtime_ns").alias("mtime_nsec"),
    )


def resolve_entries(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    """Entries with their inode's type and size; dangling ones drop out."""
    return entries.join(inodes.select(F.col("ino").alias("child_ino"), "file_type", "size"), "child_ino").select(
        "parent_ino", "name", "child_ino", "file_type", "size"
    )


def parents(entries: DataFrame, dirs: DataFrame) -> DataFrame:
    """ino, parent_ino of each directory: the root and orphans are their own."""
    up = entries.groupBy(F.col("child_ino").alias("ino")).agg(F.min("parent_ino").alias("up"))
    return dirs.select("ino").join(up, "ino", "left").select(
        "ino", F.when(F.col("ino") == ROOT_INO, F.col("ino")).otherwise(F.coalesce("up", "ino")).alias("parent_ino")
    )


def readdir(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    """dir_ino, name, ino, file_type: `.` and `..` of each directory, then its entries."""
    dirs = inodes.where(F.col("file_type") == S_IFDIR).select("ino")
    kind = F.lit(S_IFDIR)
    own = dirs.select(F.col("ino").alias("dir_ino"), F.lit(".").alias("name"), "ino", kind.alias("file_type"))
    up = parents(entries, dirs).select(F.col("ino").alias("dir_ino"), F.lit(".."), "parent_ino", kind)
    kids = resolve_entries(entries, inodes).select(F.col("parent_ino").alias("dir_ino"), "name", "child_ino", "file_type")
    return own.unionAll(up).unionAll(kids.join(dirs.withColumnRenamed("ino", "dir_ino"), "dir_ino", "left_semi"))


def paths(entries: DataFrame, max_depth: int = 255) -> DataFrame:
    """ino, path, depth of everything that the root reaches; a hard link gives two rows.
    One join a level, each stored: the number of rows has no limit. A cycle, or a tree
    deeper than max_depth, is an error."""
    spark = entries.sparkSession
    level = spark.createDataFrame([(ROOT_INO, "", 0)], "ino long, path string, depth long")
    out = level.withColumn("path", F.lit("/"))
    below = entries.select("parent_ino", F.col("child_ino").cast("long").alias("child"), "name")
    for depth in range(1, max_depth + 2):
        level = stored(
            level.join(below, level["ino"] == below["parent_ino"]).select(
                F.col("child").alias("ino"), F.concat("path", F.lit("/"), "name").alias("path"), F.lit(depth).cast("long").alias("depth")
            )
        )
        if level.isEmpty():
            return out
        out = out.unionAll(level)
    raise RuntimeError(f"paths are deeper than {max_depth} levels")


def readdir_errors(requests: DataFrame, inodes: DataFrame) -> DataFrame:
    """ino, error of listings (ino) that fail: ENOENT without an inode, ENOTDIR for other types."""
    found = requests.join(inodes.select("ino", "file_type"), "ino", "left")
    error = F.when(F.col("file_type").isNull(), "ENOENT").when(F.col("file_type") != S_IFDIR, "ENOTDIR")
    return found.select("ino", error.alias("error")).where("error is not null")


def readlinks(requests: DataFrame, inodes: DataFrame, links: DataFrame) -> DataFrame:
    """ino, target, error: EINVAL for inodes that are no symbolic link, ENOENT without an inode."""
    error = F.when(F.col("file_type").isNull(), "ENOENT").when(F.col("file_type") != S_IFLNK, "EINVAL").when(F.col("target").isNull(), "ENOENT")
    found = requests.join(inodes.select("ino", "file_type"), "ino", "left").join(links.select("ino", "target"), "ino", "left")
    return found.select("ino", F.when(error.isNull(), F.col("target")).alias("target"), error.alias("error"))


def symlink_targets(links: DataFrame) -> DataFrame:
    """ino, target, size: a link is as long as its target has bytes."""
    return links.select("ino", "target", F.octet_length("target").cast("long").alias("size"))


def latest_xattrs(log: DataFrame) -> DataFrame:
    """ino, name, value after the whole log (a null value removes)."""
    return (
        log.groupBy("ino", "name")
        .agg(F.max(F.struct("seq", "value")).alias("last"))
        .select("ino", "name", "last.value")
        .where("value is not null")
    )


def xattr_lists(xattrs: DataFrame) -> DataFrame:
    """ino, names: sorted names, each closed by a NUL, as a listing returns them."""
    names = F.array_sort(F.collect_set("name"))
    return xattrs.groupBy("ino").agg(F.concat(F.array_join(names, "\0"), F.lit("\0")).alias("names"))


def xattr_maps(xattrs: DataFrame) -> DataFrame:
    return xattrs.groupBy("ino").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("xattrs"))


def _is_regular() -> Column:
    return F.col("file_type") == S_IFREG


def used_bytes(inodes: DataFrame) -> DataFrame:
    return inodes.where(_is_regular()).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("used_bytes"))


def statfs(inodes: DataFrame, capacity: int, block: int) -> DataFrame:
    free = F.greatest(F.lit(capacity).cast("long") - F.col("used_bytes"), F.lit(0).cast("long"))
    return used_bytes(inodes).select(
        F.lit(block).cast("long").alias("block_size"),
        F.floor(F.lit(capacity).cast("long") / block).cast("long").alias("blocks"),
        F.floor(free / block).cast("long").alias("free_blocks"),
        F.floor(free / block).cast("long").alias("avail_blocks"),
        F.floor(F.lit(capacity).cast("long") / 4096).cast("long").alias("files"),
    )


def nlinks(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    """ino, nlink: names that refer to it, and one more for a directory."""
    refs = entries.groupBy(F.col("child_ino").alias("ino")).agg(F.count(F.lit(1)).alias("refs"))
    return inodes.select("ino", "file_type").join(refs, "ino", "left").select(
        "ino", (F.coalesce("refs", F.lit(0)) + F.when(F.col("file_type") == S_IFDIR, 1).otherwise(0)).cast("long").alias("nlink")
    )
