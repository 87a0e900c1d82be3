"""Integrity checks: each returns the rows that violate an invariant, none if it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import chunk_seq
from ..schema import ROOT_INO, S_IFDIR, S_IFLNK
from .compaction import live_bytes
from .namespace import nlinks


def root_is_directory(inodes: DataFrame) -> DataFrame:
    found = inodes.where((F.col("ino") == ROOT_INO) & (F.col("file_type") == S_IFDIR)).agg(F.count(F.lit(1)).alias("n"))
    return found.where("n <> 1").select(F.lit(ROOT_INO).cast("long").alias("ino"), "n")


def dangling_entries(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    return entries.join(inodes.select(F.col("ino").alias("child_ino")), "child_ino", "left_anti").select("parent_ino", "name", "child_ino")


def parent_not_directory(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    dirs = inodes.where(F.col("file_type") == S_IFDIR).select(F.col("ino").alias("parent_ino"))
    return entries.join(dirs, "parent_ino", "left_anti").select("parent_ino", "name", "child_ino")


def duplicate_names(entries: DataFrame) -> DataFrame:
    return entries.groupBy("parent_ino", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def wrong_nlink(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    want = nlinks(entries, inodes).withColumnRenamed("nlink", "expected")
    return inodes.select("ino", "nlink").join(want, "ino").where("nlink <> expected")


def negative_size(inodes: DataFrame) -> DataFrame:
    return inodes.where("size < 0").select("ino", "size")


def extents_beyond_size(extents: DataFrame, sizes: DataFrame) -> DataFrame:
    """Holes are legal, so the sum of extents may be less than the size, not more."""
    return extents.groupBy("ino").agg(F.sum("length").cast("long").alias("total")).join(sizes, "ino").where("total > size")


def overlapping_extents(extents: DataFrame) -> DataFrame:
    """A running maximum of ends replaces a self-join."""
    before = F.max(F.col("file_offset") + F.col("length")).over(
        W.partitionBy("ino").orderBy("file_offset", "length").rowsBetween(W.unboundedPreceding, -1)
    )
    return extents.withColumn("before", before).where("file_offset < before").select("ino", "file_offset", "length", "before")


def ino_not_below_next(inodes: DataFrame, next_ino: int) -> DataFrame:
    return inodes.where(F.col("ino") >= next_ino).select("ino")


def target_of_other_type(symlinks: DataFrame, inodes: DataFrame) -> DataFrame:
    links = inodes.where(F.col("file_type") == S_IFLNK).select("ino")
    return symlinks.join(links, "ino", "left_anti").select("ino", "target")


def xattr_without_inode(xattrs: DataFrame, inodes: DataFrame) -> DataFrame:
    return xattrs.join(inodes.select("ino"), "ino", "left_anti").select("ino", "name")


def odd_block_size(inodes: DataFrame, block: int) -> DataFrame:
    return inodes.where(F.col("blksize") != block).select("ino", "blksize")


def chunk_state(chunks: DataFrame, limit: int, next_seq: int) -> DataFrame:
    """chunk_id, reason: sizes out of range, numbers at or above the next one, and any but one active chunk."""
    reason = (
        F.when(F.col("size") < 0, "negative size")
        .when((F.col("status") == "Active") & (F.col("size") > limit), "active chunk too large")
        .when(chunk_seq("chunk_id") >= next_seq, "number not below the next")
    )
    rows = chunks.select("chunk_id", reason.alias("reason")).where("reason is not null")
    active = chunks.agg(F.count(F.when(F.col("status") == "Active", 1)).alias("n")).where("n <> 1")
    return rows.unionAll(active.select(F.lit(None).cast("string"), F.lit("not one active chunk")))


def extent_out_of_chunk(extents: DataFrame, chunks: DataFrame) -> DataFrame:
    return (
        extents.join(chunks.select("chunk_id", F.col("size").alias("chunk_size")), "chunk_id", "left")
        .where(F.col("chunk_size").isNull() | (F.col("chunk_offset") < 0) | (F.col("chunk_offset") + F.col("length") > F.col("chunk_size")))
        .select("ino", "chunk_id", "chunk_offset", "length")
    )


def orphans_in_output(extents: DataFrame, output: DataFrame) -> DataFrame:
    """Chunks that a compaction wrote and whose bytes are not all live."""
    return output.join(live_bytes(extents), "chunk_id", "left").where(F.coalesce("live", F.lit(0)) != F.col("size")).select("chunk_id", "size", "live")


def unsealed_targets(chosen: DataFrame, chunks: DataFrame) -> DataFrame:
    return chosen.select("chunk_id").join(chunks.where("status = 'Sealed'"), "chunk_id", "left_anti")


def over_capacity(inodes: DataFrame, capacity: int) -> DataFrame:
    from .namespace import used_bytes

    return used_bytes(inodes).where(F.col("used_bytes") > capacity)


def next_seq_bound(chunks: DataFrame, next_seq: int) -> DataFrame:
    """The number of chunks, if it is not below the next sequence number."""
    return chunks.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= next_seq)


def versions_differ(clean: DataFrame, memory: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a clean copy and of the state in memory that the other does not have; a remote
    copy is compared without access times."""
    from ..sources.snapshots import difference

    return difference(clean, memory, ignore)


def next_ino_rolled_back(copy: DataFrame, memory: DataFrame) -> DataFrame:
    """The next inode number of a copy and of memory, if the copy's is larger. A table's next
    number is the one after its largest."""
    top = lambda df, name: df.agg((F.coalesce(F.max("ino"), F.lit(0)) + 1).cast("long").alias(name))
    return top(copy, "copy_next").join(F.broadcast(top(memory, "memory_next"))).where("copy_next > memory_next")  # a row each


def reserved_listed(listing: DataFrame, index_key: str = "index.cbor") -> DataFrame:
    return listing.where(F.col("chunk_id") == index_key).select("chunk_id")
