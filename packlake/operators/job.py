"""Jobs on a store of chunks and its snapshots: compaction, flush, reads of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import snapshots
from ..sources.objects import Store
from ..sources.shared import stored
from . import compaction
from .overlay import laid_out, read_plan


def _packed(pieces: DataFrame, limit: int) -> DataFrame:
    """chunk_id, data of packed chunks, from their pieces in order: one chunk is in memory at a time."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        name, parts = None, []

        def whole():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["chunk_id", "data"])

        for batch in batches:
            for k, chunk_id in enumerate(batch.column(0).to_pylist()):
                if chunk_id != name:
                    if parts:
                        yield whole()
                    name, parts = chunk_id, []
                parts.append(batch.column(2)[k].as_py())
        if parts:
            yield whole()

    ordered = pieces.repartition("new_chunk_id").sortWithinPartitions("new_chunk_id", "new_offset")
    return ordered.select("new_chunk_id", "new_offset", "data").mapInArrow(run, "chunk_id string, data binary")


def compact(store: Store, root: str, limit: int, stamp: int, threshold: float = compaction.THRESHOLD) -> int | None:
    """One cycle: sealed chunks whose orphaned share is at the threshold or above are packed
    into new ones and removed. The new version, or None if there is nothing to do.

    Bytes are written first, then the version that points to them is published, and only then
    old chunks go. A run that is lost before publication leaves the old version whole and some
    objects that no version names; one lost after it leaves old chunks that are empty of live
    bytes, which the next cycle removes."""
    state = snapshots.load(store.spark, root)
    extents = state["extents"]
    chunks = stored(compaction.sealed(store.list()))
    chosen = stored(compaction.targets(compaction.chunk_usage(chunks, extents), threshold))
    if chosen.isEmpty():
        return None
    moved = stored(compaction.pack(extents, chosen, limit, stamp))
    wanted = moved.select("chunk_id", F.col("chunk_offset").alias("off"), F.col("length").alias("len"), "new_chunk_id", "new_offset").distinct()
    written = stored(store.put_all(_packed(store.ranges(wanted), limit)))
    bad = written.join(compaction.compacted_chunks(wanted.withColumnRenamed("len", "length")).withColumnRenamed("size", "want"), "chunk_id", "full_outer")
    if not bad.where("size is null or want is null or size <> want").isEmpty():
        raise OSError("packed chunks are not what was planned")
    after = stored(compaction.remap(extents, moved))
    if not compaction.not_preserved(extents, after).isEmpty():
        raise RuntimeError("compaction would lose or make up extents")
    version = snapshots.save(store.spark, root, state | {"extents": after})
    store.delete_all(chosen)
    return version


def read(store: Store, root: str, requests: DataFrame, version: int | None = None) -> DataFrame:
    """request_id, data of requests (request_id, ino, off, len) in a version of the files. A
    range that many requests need is read once; holes read as zeros."""
    state = snapshots.load(store.spark, root, version)
    sizes = state["inodes"].select("ino", "size")
    plan = read_plan(requests, state["extents"], sizes)
    wanted = plan.select("chunk_id", F.col("chunk_offset").alias("off"), F.col("length").alias("len"), "request_id", "out_offset")
    pieces = store.ranges(wanted).select("request_id", "out_offset", F.col("data").alias("bytes"))
    return laid_out(pieces, requests, sizes)


def flush(store: Store, root: str, writes: DataFrame, tables: dict[str, DataFrame]) -> int:
    """Make writes durable: the active chunk's bytes (chunk_id, chunk_offset, data) are put whole,
    then a version with the given tables is published. Doing it again changes no bytes."""
    chunks = writes.select("chunk_id").distinct().withColumn("size", F.lit(0).cast("long"))
    stored(store.put_all(compaction.flushed(writes, chunks)))
    return snapshots.save(store.spark, root, tables)
