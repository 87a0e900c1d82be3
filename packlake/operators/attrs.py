"""Folds of the operation log: inode attributes, names and access times.

The log is append-only; a state is the fold of the log by sequence number. Each fold is one
grouped aggregate, so a later log is folded onto an earlier state by uniting the two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import blocks512
from ..schema import S_IFDIR
from ..sources.shared import stored

#: Attributes that setattr may change; a null leaves one as it is.
SETTABLE = ("mode", "uid", "gid", "size", "atime_ns", "mtime_ns")


def latest_attrs(log: DataFrame, fields: tuple[str, ...] = SETTABLE) -> DataFrame:
    """ino and the last non-null value of each field by seq, and ctime_ns (time of the last change)."""
    fields = tuple(f for f in fields if f in log.columns)
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return log.groupBy("ino").agg(*last, F.max_by("ts_ns", "seq").alias("ctime_ns"))


def apply_attrs(inodes: DataFrame, log: DataFrame) -> DataFrame:
    """Inodes after a log of changes (ino, seq, ts_ns and any of SETTABLE; a null leaves a field
    as it is). Blocks follow the size; a change of size sets the modification time, also over one
    that is given with it; every change sets the time of change."""
    fields = [f for f in SETTABLE if f in log.columns and f in inodes.columns]
    timed = "size" in fields and "mtime_ns" in inodes.columns
    rows = log
    if timed:
        before = W.partitionBy("ino").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
        start = inodes.select("ino", F.col("size").alias("__start"))
        rows = log.join(start, "ino").withColumn("__was", F.coalesce(F.last("size", ignorenulls=True).over(before), "__start"))
        given = F.col("mtime_ns") if "mtime_ns" in log.columns else F.lit(None).cast("long")
        rows = rows.withColumn("mtime_ns", F.when(F.col("size") != F.col("__was"), F.col("ts_ns")).otherwise(given))
        fields = [*dict.fromkeys([*fields, "mtime_ns"])]
    new = latest_attrs(rows, tuple(fields))
    new = new.select(F.col("ino").alias("__ino"), *(F.col(f).alias(f"__{f}") for f in [*fields, "ctime_ns"]))
    joined = inodes.join(new, inodes["ino"] == F.col("__ino"), "left")
    changed = [*fields, "ctime_ns"]
    out = joined.select(
        *(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in inodes.columns)
    )
    return out.withColumn("blocks", blocks512("size")) if {"size", "blocks"} <= set(inodes.columns) else out


def trimmed(extents: DataFrame, log: DataFrame) -> DataFrame:
    """Extents after the sizes that a log of changes sets: nothing beyond the smallest is left."""
    from .overlay import truncate_extents

    return truncate_extents(extents, log.groupBy("ino").agg(F.min("size").alias("size")).where("size is not null"))


def entry_times(log: DataFrame) -> DataFrame:
    """ino, mtime_ns, ctime_ns that operations on names (with ts_ns) set: both times of the
    directories they change, and the time of change of the inode they name."""
    dirs = [log.select(F.col(c).alias("ino"), F.col("ts_ns").alias("mtime_ns"), F.col("ts_ns").alias("ctime_ns")) for c in ("parent_ino", "dst_parent")]
    child = log.select("ino", F.lit(None).cast("long").alias("mtime_ns"), F.col("ts_ns").alias("ctime_ns"))
    rows = dirs[0].unionAll(dirs[1]).unionAll(child).where("ino is not null")
    return rows.groupBy("ino").agg(F.max("mtime_ns").alias("mtime_ns"), F.max("ctime_ns").alias("ctime_ns"))


def apply_entry_times(inodes: DataFrame, log: DataFrame) -> DataFrame:
    new = entry_times(log).select(F.col("ino").alias("__ino"), F.col("mtime_ns").alias("__m"), F.col("ctime_ns").alias("__c"))
    joined = inodes.join(new, inodes["ino"] == F.col("__ino"), "left")
    times = {"mtime_ns": F.coalesce("__m", "mtime_ns"), "ctime_ns": F.coalesce("__c", "ctime_ns")}
    return joined.select(*(times[c].alias(c) if c in times else F.col(c) for c in inodes.columns))


def xattr_rejections(xattrs: DataFrame, log: DataFrame) -> DataFrame:
    """ino, name, seq of removals (a null value) of attributes that are not there at that time."""
    start = xattrs.select("ino", "name", F.lit(-1).cast("long").alias("seq"), "value")
    by_name = W.partitionBy("ino", "name").orderBy("seq")
    rows = start.unionByName(log.select("ino", "name", "seq", "value")).withColumn("was", F.lag("value").over(by_name))
    return rows.where("seq >= 0 and value is null and was is null").select("ino", "name", "seq")


def access_times(log: DataFrame) -> DataFrame:
    """ino, atime: the time of the last read."""
    return log.where("op = 'read'").groupBy("ino").agg(F.max_by("ts", "seq").alias("atime"))


def allocate_inodes(creates: DataFrame, next_ino: int, lot_seqs: int = 1 << 20) -> DataFrame:
    """creates (seq, file_type, mode, uid, gid, ts_ns) with fresh numbers in the order of seq;
    a directory starts with one link, others with none."""
    from ..sources.fixtures import running_number

    numbered = running_number(creates, F.floor(F.col("seq") / lot_seqs), ["seq"], "__n")
    return numbered.select(
        (F.col("__n") + F.lit(next_ino - 1)).cast("long").alias("ino"),
        "seq",
        "file_type",
        "mode",
        F.when(F.col("file_type") == S_IFDIR, 1).otherwise(0).cast("long").alias("nlink"),
        "uid",
        "gid",
        F.lit(0).cast("long").alias("size"),
        *(F.col("ts_ns").alias(c) for c in ("atime_ns", "mtime_ns", "ctime_ns")),
    )


def entry_changes(log: DataFrame) -> DataFrame:
    """seq, step, parent_ino, name, child_ino (null: removed) of link, unlink, rmdir and rename
    operations. A rename removes and adds under one number; one onto itself changes nothing."""
    same = (F.col("parent_ino") == F.col("dst_parent")) & (F.col("name") == F.col("dst_name"))
    add = log.where(F.col("op").isin("create", "mkdir", "symlink", "link")).select(
        "seq", F.lit(1).alias("step"), "parent_ino", "name", F.col("ino").alias("child_ino")
    )
    gone = log.where(F.col("op").isin("unlink", "rmdir") | ((F.col("op") == "rename") & ~same)).select(
        "seq", F.lit(0).alias("step"), "parent_ino", "name", F.lit(None).cast("long").alias("child_ino")
    )
    moved = log.where((F.col("op") == "rename") & ~same).select(
        "seq", F.lit(1).alias("step"), F.col("dst_parent").alias("parent_ino"), F.col("dst_name").alias("name"), F.col("ino").alias("child_ino")
    )
    return add.unionAll(gone).unionAll(moved)


def same_inode_renames(entries: DataFrame, log: DataFrame) -> DataFrame:
    """seq of renames onto another name of the same inode: they change nothing. What the target
    names at that time can depend on such renames before it, so they are found in rounds: as
    many as the longest chain of them, mostly one."""
    renames = log.where("op = 'rename'")
    found = log.sparkSession.createDataFrame([], "seq long")
    if renames.isEmpty():
        return found
    n = 0
    while True:
        done = log.join(found, "seq", "left_anti")
        state = F.struct("child_ino")
        rows = (
            entries.select(F.lit(-1).cast("long").alias("seq"), F.lit(1).alias("step"), "parent_ino", "name", state.alias("is"))
            .unionByName(entry_changes(done).select("seq", "step", "parent_ino", "name", state.alias("is")))
            .withColumn("probe", F.lit(None).cast("long"))
            .unionByName(
                renames.select(
                    "seq", F.lit(-1).alias("step"), F.col("dst_parent").alias("parent_ino"), F.col("dst_name").alias("name"),
                    F.lit(None).cast("struct<child_ino:bigint>").alias("is"), F.col("ino").alias("probe"),
                )
            )
        )
        before = W.partitionBy("parent_ino", "name").orderBy("seq", "step").rowsBetween(W.unboundedPreceding, -1)
        now = rows.withColumn("was", F.last("is", ignorenulls=True).over(before)).where("probe is not null and was.child_ino = probe")
        found = stored(now.select("seq"))
        if found.count() == n:
            return found
        n = found.count()


def fold_entries(entries: DataFrame, log: DataFrame) -> DataFrame:
    """parent_ino, name, child_ino after a log of operations that were done: the last change of
    each name wins; a rename onto another name of the same inode changes nothing."""
    log = log.join(same_inode_renames(entries, log), "seq", "left_anti")
    start = entries.select(F.lit(-1).cast("long").alias("seq"), F.lit(1).alias("step"), "parent_ino", "name", "child_ino")
    return (
        start.unionByName(entry_changes(log))
        .groupBy("parent_ino", "name")
        .agg(F.max(F.struct("seq", "step", "child_ino")).alias("last"))
        .select("parent_ino", "name", "last.child_ino")
        .where("child_ino is not null")
    )


def rejected_operations(entries: DataFrame, inodes: DataFrame, log: DataFrame) -> DataFrame:
    """seq, reason of operations that a state does not allow, judged against that state:
    missing parents, parents that are no directory, names that exist or do not, links to
    directories, removal of directories that are not empty, moves of a directory into itself."""
    kind = inodes.select("ino", "file_type")
    named = entries.select(F.col("parent_ino").alias("e_parent"), F.col("name").alias("e_name"), F.col("child_ino").alias("e_child"))
    busy = entries.select(F.col("parent_ino").alias("busy")).distinct()
    up = kind.select(F.col("ino").alias("p_ino"), F.col("file_type").alias("p_type"))
    own = kind.select(F.col("ino").alias("o_ino"), F.col("file_type").alias("o_type"))
    x = (
        log.join(up, F.col("parent_ino") == F.col("p_ino"), "left")
        .join(named, (F.col("parent_ino") == F.col("e_parent")) & (F.col("name") == F.col("e_name")), "left")
        .join(own, F.coalesce("e_child", "ino") == F.col("o_ino"), "left")
        .join(busy, F.col("e_child") == F.col("busy"), "left")
    )
    adds = F.col("op").isin("create", "mkdir", "symlink", "link")
    takes = F.col("op").isin("unlink", "rmdir", "rename")
    is_dir = F.col("o_type") == S_IFDIR
    reason = (
        F.when(F.col("p_ino").isNull(), "no parent")
        .when(F.col("p_type") != S_IFDIR, "parent is not a directory")
        .when(adds & F.col("e_child").isNotNull(), "exists")
        .when(takes & F.col("e_child").isNull(), "no entry")
        .when((F.col("op") == "link") & is_dir, "link to a directory")
        .when((F.col("op") == "unlink") & is_dir, "is a directory")
        .when((F.col("op") == "rmdir") & ~is_dir, "not a directory")
        .when((F.col("op") == "rmdir") & F.col("busy").isNotNull(), "not empty")
        .when((F.col("op") == "rename") & is_dir & (F.col("dst_parent") == F.col("e_child")), "into itself")
    )
    return x.select("seq", reason.alias("reason")).where("reason is not null")


def surviving(inodes: DataFrame, entries: DataFrame, root: int = 1) -> DataFrame:
    """Inodes that a name still refers to, and the root; the rest are freed."""
    named = entries.select(F.col("child_ino").alias("ino")).unionAll(entries.sparkSession.range(root, root + 1).select(F.col("id").alias("ino")))
    return inodes.join(named.distinct(), "ino", "left_semi")


def cascade(rows: DataFrame, inodes: DataFrame) -> DataFrame:
    """Extents, links or attributes of inodes that survive."""
    return rows.join(inodes.select("ino"), "ino", "left_semi")
