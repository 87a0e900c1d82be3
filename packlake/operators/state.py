"""The whole state of a file system after a log of operations that were done (OP_LOG).

Names, inodes, extents, links, attributes and chunks each are one fold, so that a batch of
the log is applied by a few grouped aggregates, however many operations it has. In the log,
`create`, `mkdir` and `symlink` carry the new inode's number, type bits and mode, `symlink`
its target as dst_name; `write` an extent; `setattr` what it sets; `read` the time of access;
`setxattr` and `removexattr` a name and a value."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import blocks512
from ..schema import BLOCK_SIZE, S_IFDIR, S_IFLNK, S_IFREG, TABLES
from ..sources.shared import stored
from . import attrs, compaction, namespace
from .overlay import file_growth, overlay

_BORN = ("create", "mkdir", "symlink")
_NAMES = (*_BORN, "link", "unlink", "rmdir", "rename")


def _byte_log(state: Mapping[str, DataFrame], log: DataFrame) -> DataFrame:
    """ino, seq, op, off, len and the place of writes: extents and sizes so far, then the log.
    Only files that the log writes or cuts take part."""
    changed = log.where((F.col("op") == "write") | ((F.col("op") == "setattr") & F.col("size").isNotNull()))
    touched = changed.select("ino").distinct()
    zero, none = F.lit(0).cast("long"), F.lit(None)
    number = -F.row_number().over(W.partitionBy("ino").orderBy("file_offset")).cast("long")
    old = state["extents"].join(touched, "ino", "left_semi").select(
        "ino", number.alias("seq"), F.lit("write").alias("op"), F.col("file_offset").alias("off"), F.col("length").alias("len"), "chunk_id", "chunk_offset"
    )
    size = state["inodes"].join(touched, "ino", "left_semi").select(
        "ino", F.lit(-(1 << 62)).alias("seq"), F.lit("truncate"), F.col("size"), zero, none.cast("string"), none.cast("long")
    )
    cut = F.col("op") == "setattr"
    new = changed.select(
        "ino", "seq", F.when(cut, "truncate").otherwise("write"), F.when(cut, F.col("size")).otherwise(F.col("offset")),
        F.when(cut, zero).otherwise(F.col("length")), "chunk_id", "chunk_offset",
    )
    return size.toDF(*old.columns).unionAll(old).unionAll(new)


def _extents(state: Mapping[str, DataFrame], bytes_: DataFrame) -> DataFrame:
    place = bytes_.where("op = 'write'").select("ino", "seq", "chunk_id", F.col("chunk_offset").alias("begin"))
    found = overlay(bytes_.select("ino", "seq", "op", "off", "len")).join(place, ["ino", "seq"])
    new = found.select("ino", "chunk_id", (F.col("begin") + F.col("skip")).alias("chunk_offset"), "length", "file_offset")
    return state["extents"].join(bytes_.select("ino").distinct(), "ino", "left_anti").unionByName(new)


def _inodes(state: Mapping[str, DataFrame], log: DataFrame, bytes_: DataFrame, entries: DataFrame) -> DataFrame:
    kind = F.when(F.col("op") == "mkdir", S_IFDIR).when(F.col("op") == "symlink", S_IFLNK).otherwise(S_IFREG)
    zero = F.lit(0).cast("long")
    born = log.where(F.col("op").isin(*_BORN)).select(
        "ino", kind.alias("file_type"), F.coalesce("mode", F.lit(0)).alias("mode"), zero.alias("nlink"),
        F.coalesce("uid", zero).alias("uid"), F.coalesce("gid", zero).alias("gid"),
        F.when(F.col("op") == "symlink", F.octet_length("dst_name")).otherwise(0).cast("long").alias("size"),
        *(F.col("ts_ns").alias(c) for c in ("atime_ns", "mtime_ns", "ctime_ns")),
        F.lit(BLOCK_SIZE).alias("blksize"), zero.alias("blocks"), zero.alias("rdev"),
    )
    rows = state["inodes"].unionByName(born)
    # the size after each write and cut; a write sets the modification time also where it does not grow the file
    grown = file_growth(bytes_.withColumn("at", F.col("seq"))).where("seq > 0").select("ino", "seq", F.col("size").alias("now"))
    what = log.where(F.col("op").isin("write", "setattr")).join(grown, ["ino", "seq"], "left")
    changes = what.select(
        "ino", "seq", "ts_ns", "mode", "uid", "gid", F.col("now").alias("size"), F.when(F.col("op") == "write", F.col("ts_ns")).alias("mtime_ns")
    )
    rows = attrs.apply_attrs(rows, changes)
    rows = attrs.apply_entry_times(rows, log.where(F.col("op").isin(*_NAMES)).withColumn("dst_parent", F.when(F.col("op") == "rename", F.col("dst_parent"))))
    seen = log.where("op = 'read'").groupBy(F.col("ino").alias("__ino")).agg(F.max("ts_ns").alias("__seen"))
    rows = rows.join(seen, rows["ino"] == F.col("__ino"), "left").withColumn("atime_ns", F.coalesce("__seen", "atime_ns"))
    rows = attrs.surviving(rows.select(*(f.name for f in TABLES["inodes"].fields)), entries)
    counts = namespace.nlinks(entries, rows).select(F.col("ino").alias("__ino"), F.col("nlink").alias("__n"))
    out = rows.join(counts, rows["ino"] == F.col("__ino")).withColumn("nlink", F.col("__n")).withColumn("blocks", blocks512("size"))
    return out.select(*(F.col(f.name).cast(f.dataType) for f in TABLES["inodes"].fields))


def apply(state: Mapping[str, DataFrame], log: DataFrame) -> dict[str, DataFrame]:
    """The tables of a file system after a batch of operations (seq above 0), each stored once."""
    names = log.where(F.col("op").isin(*_NAMES))
    entries = stored(attrs.fold_entries(state["dir_entries"], names))
    bytes_ = stored(_byte_log(_with_born(state, log), log))
    inodes = stored(_inodes(state, log, bytes_, entries))
    linked = log.where("op = 'symlink'").select("ino", F.col("dst_name").alias("target"))
    x = log.where(F.col("op").isin("setxattr", "removexattr")).select(
        "ino", "seq", F.col("xattr_name").alias("name"), F.when(F.col("op") == "setxattr", F.col("xattr_value")).alias("value")
    )
    xattrs = state["xattrs"].withColumn("seq", F.lit(-1).cast("long")).unionByName(x)
    used = log.where("op = 'write'").select("chunk_id", (F.col("chunk_offset") + F.col("length")).alias("size"))
    chunks = state["chunks"].select("chunk_id", "size").unionAll(used).groupBy("chunk_id").agg(F.max("size").alias("size"))
    out = {
        "inodes": inodes,
        "dir_entries": entries,
        "extents": attrs.cascade(_extents(state, bytes_), inodes),
        "symlinks": attrs.cascade(state["symlinks"].unionByName(linked), inodes),
        "xattrs": attrs.cascade(namespace.latest_xattrs(xattrs), inodes),
        "chunks": compaction.with_status(chunks),
    }
    return {k: stored(df.select(*(f.name for f in TABLES[k].fields))) for k, df in out.items()}


def _with_born(state: Mapping[str, DataFrame], log: DataFrame) -> dict[str, DataFrame]:
    """state whose inodes have the new ones, which begin empty."""
    born = log.where(F.col("op").isin(*_BORN)).select("ino", F.lit(0).cast("long").alias("size"))
    return {**state, "inodes": state["inodes"].select("ino", "size").unionByName(born)}
