"""What the operators share: tables, shared storage, exact distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The session names it; where it doesn't, a
    temporary folder is taken if driver and executors are one process, else it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        where = tempfile.mkdtemp(prefix="ckpt-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read again: lineage is cut and
    lost executors cost nothing but the read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share_drawn(seed: str, key: str, share: float):
    """Whether a row is in a sample of a share of all, by a hash; fine enough for any number of rows."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1) < F.lit(min(int(share * 2.0**63), (1 << 63) - 1))


def weighted_bounds(df: DataFrame, key: str, weight: str, target: int, bits: int, cells: int = 1 << 15) -> list[int]:
    """Ascending cut points of a key of 0 .. 2**bits - 1, between which about `target` of the
    weight lies. Cells of leading bits are summed; those over the target are cut finer, as
    long as they have bits. Each pass collects about `cells` rows or two for each heavy cell."""
    heavy, shift, cuts = [0], bits, []
    while heavy and shift:
        step = min(shift, max(1, (cells // len(heavy)).bit_length() - 1))
        inside = df if shift == bits else df.where(F.shiftright(key, shift).isin(heavy))
        shift -= step
        sums = inside.groupBy(F.shiftright(key, shift).alias("c")).agg(F.sum(weight).alias("w")).collect()
        found, heavy, acc, before = sorted(map(tuple, sums)), [], 0, None
        for c, w in found:
            fresh = before is None or before >> step != c >> step
            if fresh or acc + w > target:
                cuts.append(c << shift)
                acc = 0
            acc += w
            if w > target:
                heavy.append(c)
            before = c
    return sorted(set(cuts) - {0})


def tidied(run):
    """A function on Arrow batches that gives its memory back when a task ends: workers
    live on from stage to stage, and what one stage freed should not count in the next."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, column: int, rows: int = 2500, size: int = 1 << 23):
    """Parts of a batch of at most `rows` rows and about `size` bytes of a text column."""
    bytes_ = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(bytes_) - bytes_
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(before, before[lo] + size))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def range_part(column, bounds: list[int]):
    """The number of cut points at or below a long column: a binary search in a
    constant array, so the expression stays small for any number of ranges."""
    array = F.lit(bounds).cast("array<bigint>")
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda lo, step: F.when(F.get(array, lo + step - 1) <= column, lo + step).otherwise(lo),
    )
