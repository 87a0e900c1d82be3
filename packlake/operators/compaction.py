"""Chunk accounting, packing and compaction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import chunk_id, chunk_seq, is_chunk_object
from ..sources.shared import stored

THRESHOLD = 0.3
#: Chunks that are packed together; every lot has output chunks of its own.
LOT_CHUNKS = 1024


def live_bytes(extents: DataFrame) -> DataFrame:
    """chunk_id, live: a bag sum, equal lengths count each."""
    return extents.groupBy("chunk_id").agg(F.sum("length").cast("long").alias("live"))


def chunk_usage(chunks: DataFrame, extents: DataFrame) -> DataFrame:
    """chunk_id, size, live, orphan, fraction of every chunk (fraction null for an empty one)."""
    live = F.coalesce("live", F.lit(0)).cast("long")
    orphan = F.col("size") - F.col("live")
    return (
        chunks.select("chunk_id", "size")
        .join(live_bytes(extents), "chunk_id", "left")
        .select("chunk_id", "size", live.alias("live"))
        .withColumn("orphan", orphan)
        .withColumn("fraction", F.when(F.col("size") > 0, F.col("orphan").cast("double") / F.col("size").cast("double")))
    )


def next_chunk_seq(chunks: DataFrame) -> DataFrame:
    """The number after the largest one in use; foreign ids are ignored."""
    return chunks.agg((F.coalesce(F.max(chunk_seq("chunk_id")), F.lit(0)) + 1).cast("long").alias("next_seq"))


def active(chunks: DataFrame) -> DataFrame:
    """active_seq: the number of the chunk that is appended to, the largest one; one row."""
    return chunks.agg(F.coalesce(F.max(chunk_seq("chunk_id")), F.lit(-1)).alias("active_seq"))


def sealed(chunks: DataFrame) -> DataFrame:
    """Chunk objects other than the active one and the index."""
    seq = F.coalesce(chunk_seq("chunk_id"), F.lit(-2))
    last = F.broadcast(active(chunks))  # one row
    return chunks.where(is_chunk_object("chunk_id")).join(last, seq != F.col("active_seq")).drop("active_seq")


def with_status(chunks: DataFrame) -> DataFrame:
    """chunk_id, status, size: the chunk of the largest number is active, by value, not by name."""
    last = F.broadcast(active(chunks))  # one row
    is_active = F.coalesce(chunk_seq("chunk_id") == F.col("active_seq"), F.lit(False))
    return chunks.join(last).select("chunk_id", F.when(is_active, "Active").otherwise("Sealed").alias("status"), "size")


def flushed(writes: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, size, data of the active chunk's appended bytes (chunk_id, chunk_offset, data), put
    together for a flush; the chunk stays active. One chunk's bytes are in one task."""
    own = writes.join(F.broadcast(active(chunks)), chunk_seq("chunk_id") == F.col("active_seq"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_offset", F.hex("data").alias("x"))))
    data = F.unhex(F.array_join(F.transform("p", lambda p: p["x"]), ""))
    return own.groupBy("chunk_id").agg(parts.alias("p")).select("chunk_id", F.octet_length(data).cast("long").alias("size"), data.alias("data"))


def targets(usage: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Chunks worth rewriting: empty ones, and those with an orphaned share at the threshold or above."""
    return usage.where((F.col("size") == 0) | (F.col("fraction") >= threshold))


def next_fit(lengths: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """(bin, offset in it) of each length: a bin is closed when the next one does not fit;
    one that is longer than the limit has a bin of its own."""
    at, used = 0, 0
    for n in lengths:
        if used and used + n > limit:
            at, used = at + 1, 0
        yield at, used
        used += n


def placements(writes: DataFrame, limit: int, lot: str = "lot", first_seq: int = 1) -> DataFrame:
    """lot, ino, seq, len, chunk_id, chunk_offset, rejected of appended writes: each lot appends
    to chunks of its own, in the order of ino and seq, rotating when a write does not fit. A write
    longer than a chunk is rejected, without a place. Lots number their chunks one after another."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ino", "seq"], kind="stable")
        at = list(next_fit(pdf["len"].tolist(), limit))
        return pd.DataFrame(
            {
                "lot": pdf[lot], "ino": pdf["ino"], "seq": pdf["seq"], "len": pdf["len"],
                "bin": [x[0] for x in at], "chunk_offset": [x[1] for x in at],
            }
        )

    fits = F.col("len") <= limit
    placed = stored(
        writes.where(fits).groupBy(lot).applyInPandas(run, "lot long, ino long, seq long, len long, bin long, chunk_offset long")
    )
    bins = placed.groupBy("lot").agg((F.max("bin") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("lot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per lot
    named = placed.join(bins.select("lot", before.alias("before")), "lot").select(
        "lot", "ino", "seq", "len", chunk_id(F.col("before") + F.col("bin") + first_seq).alias("chunk_id"), "chunk_offset", F.lit(False).alias("rejected")
    )
    none = F.lit(None)
    refused = writes.where(~fits).select(
        F.col(lot).alias("lot"), "ino", "seq", "len", none.cast("string").alias("chunk_id"), none.cast("long").alias("chunk_offset"), F.lit(True).alias("rejected")
    )
    return named.unionByName(refused)


def pack(extents: DataFrame, chosen: DataFrame, limit: int, stamp: int, lot_chunks: int = LOT_CHUNKS) -> DataFrame:
    """Live extents of the chosen chunks with their new place: ino, chunk_id, chunk_offset,
    length, file_offset, new_chunk_id, new_offset. Extents are taken by chunk and offset;
    a lot of chunks is packed by one task into output chunks of its own."""
    lot = F.floor(F.coalesce(chunk_seq("chunk_id"), F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30))) / lot_chunks)
    live = extents.join(chosen.select("chunk_id"), "chunk_id", "left_semi").withColumn("lot", lot.cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "chunk_id", "chunk_offset", "ino", "file_offset"], kind="stable").reset_index(drop=True)
        at = list(next_fit(pdf["length"].tolist(), limit))
        name = f"compacted-{stamp}-"
        pdf["new_chunk_id"] = [f"{name}{lot * 1_000_000 + x[0]}" for lot, x in zip(pdf["lot"], at, strict=True)]
        pdf["new_offset"] = [x[1] for x in at]
        return pdf.drop(columns=["lot", "order"])

    order = F.coalesce(chunk_seq("chunk_id"), F.lit(0)).alias("order")
    return live.select("lot", order, "ino", "chunk_id", "chunk_offset", "length", "file_offset").groupBy("lot").applyInPandas(
        run,
        "ino long, chunk_id string, chunk_offset long, length long, file_offset long, new_chunk_id string, new_offset long",
    )


def remap(extents: DataFrame, moved: DataFrame) -> DataFrame:
    """Extents after the move; rows that were not moved stay. moved: the columns of `pack`."""
    new = moved.select("chunk_id", "chunk_offset", "new_chunk_id", "new_offset").dropDuplicates(["chunk_id", "chunk_offset"])
    return extents.join(new, ["chunk_id", "chunk_offset"], "left").select(
        "ino",
        F.coalesce("new_chunk_id", "chunk_id").alias("chunk_id"),
        F.coalesce("new_offset", "chunk_offset").alias("chunk_offset"),
        "length",
        "file_offset",
    )


def retire(chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    return chunks.join(chosen.select("chunk_id"), "chunk_id", "left_anti")


def not_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Logical ranges that the move lost or made up; empty if it is safe."""
    key = ["ino", "file_offset", "length"]
    a, b = before.select(*key), after.select(*key)
    return a.exceptAll(b).withColumn("side", F.lit("lost")).unionAll(b.exceptAll(a).withColumn("side", F.lit("new")))


def compacted_chunks(moved: DataFrame) -> DataFrame:
    """chunk_id, size of the chunks that packing writes."""
    return moved.groupBy(F.col("new_chunk_id").alias("chunk_id")).agg(F.sum("length").cast("long").alias("size"))


def fetch_list(plan: DataFrame) -> DataFrame:
    """Each chunk that a read plan needs, once, with the bytes taken from it."""
    return plan.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("reads"), F.sum("length").cast("long").alias("bytes"))
