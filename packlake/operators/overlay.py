"""Byte overlay of a write log: the last writer of each byte wins, truncation cuts.

A write is first clipped by the truncations after it (the smallest later size), which is a
running minimum over the file's log; what is left are plain intervals. They are cut at
multiples of `stripe` so that a long or hot file is worked on in many tasks, and equal
intervals are reduced to the last one while they are shuffled. Inside a stripe, elementary
segments between all ends take the largest sequence number that covers them; touching
segments of one write become one extent again.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STRIPE = 1 << 20
_NEVER = (1 << 63) - 1


def clipped_writes(log: DataFrame) -> DataFrame:
    """ino, seq, lo, hi, base: what later truncations leave of each write (base: its first byte)."""
    later = W.partitionBy("ino").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    limit = F.coalesce(F.min(F.when(F.col("op") == "truncate", F.col("off"))).over(later), F.lit(_NEVER))
    return (
        log.withColumn("limit", limit)
        .where("op = 'write' and len > 0")
        .select("ino", "seq", F.col("off").alias("lo"), F.least(F.col("off") + F.col("len"), F.col("limit")).alias("hi"), F.col("off").alias("base"))
        .where("lo < hi")
    )


def overlay(log: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """ino, seq, file_offset, length, skip (bytes of the write before this piece) of the
    extents that are visible after the whole log. log: ino, seq, op (write or truncate), off, len."""
    pieces = clipped_writes(log).select(
        "ino", "seq", "lo", "hi", "base",
        F.explode(F.sequence(F.floor(F.col("lo") / stripe), F.floor((F.col("hi") - 1) / stripe))).alias("stripe"),
    )
    pieces = (
        pieces.select(
            "ino", "stripe",
            F.greatest("lo", F.col("stripe") * stripe).alias("lo"),
            F.least("hi", (F.col("stripe") + 1) * stripe).alias("hi"),
            F.struct("seq", "base").alias("w"),
        )
        .groupBy("ino", "stripe", "lo", "hi")
        .agg(F.max("w").alias("w"))
        .select("ino", "stripe", "lo", "hi", "w.seq", "w.base")
    )
    ends = (
        pieces.select("ino", "stripe", F.explode(F.array("lo", "hi")).alias("p"))
        .distinct()
        .withColumn("q", F.lead("p").over(W.partitionBy("ino", "stripe").orderBy("p")))
        .where("q is not null")
    )
    won = (
        ends.join(pieces, ["ino", "stripe"])
        .where((F.col("lo") <= F.col("p")) & (F.col("hi") >= F.col("q")))
        .groupBy("ino", "p", "q")
        .agg(F.max(F.struct("seq", "base")).alias("w"))
        .select("ino", "p", "q", "w.seq", "w.base")
    )
    by_file = W.partitionBy("ino").orderBy("p")
    fresh = (F.lag("seq").over(by_file) == F.col("seq")) & (F.lag("q").over(by_file) == F.col("p"))
    return (
        won.withColumn("run", F.sum(F.when(fresh, 0).otherwise(1)).over(by_file))
        .groupBy("ino", "run")
        .agg(F.min("seq").alias("seq"), F.min("p").alias("file_offset"), F.max("q").alias("end"), F.min("base").alias("base"))
        .select("ino", "seq", "file_offset", (F.col("end") - F.col("file_offset")).alias("length"), (F.col("file_offset") - F.col("base")).alias("skip"))
    )


def extents(log: DataFrame, placed: DataFrame, chunk_bytes: int, stripe: int = STRIPE) -> DataFrame:
    """ino, chunk_id, chunk_offset, length, file_offset. placed: ino, seq, pos, chunk_seq."""
    return (
        overlay(log, stripe)
        .join(placed.select("ino", "seq", "pos", "chunk_seq"), ["ino", "seq"])
        .select(
            "ino",
            F.format_string("chunk-%08d", "chunk_seq").alias("chunk_id"),
            (F.col("pos") - F.col("chunk_seq") * chunk_bytes + F.col("skip")).alias("chunk_offset"),
            "length",
            "file_offset",
        )
    )


def append_extents(current: DataFrame, new: DataFrame) -> DataFrame:
    """Extents added without looking for overlap."""
    return current.unionByName(new)


def truncate_extents(current: DataFrame, sizes: DataFrame) -> DataFrame:
    """Extents cut to new sizes (ino, size); growth adds nothing."""
    limit = F.coalesce(F.col("__size"), F.lit(_NEVER))
    return (
        current.join(sizes.select("ino", F.col("size").alias("__size")), "ino", "left")
        .where(F.col("file_offset") < limit)
        .withColumn("length", F.least("length", limit - F.col("file_offset")))
        .drop("__size")
    )


def file_sizes(log: DataFrame) -> DataFrame:
    """ino, size: the last truncation's size, or the end of a later write that lies beyond."""
    w = W.partitionBy("ino")
    cut = F.max(F.when(F.col("op") == "truncate", F.struct("seq", "off"))).over(w)
    return (
        log.withColumn("cut", cut)
        .groupBy("ino")
        .agg(
            F.greatest(
                F.coalesce(F.max("cut.off"), F.lit(0)),
                F.coalesce(
                    F.max(
                        F.when(
                            (F.col("op") == "write") & (F.col("cut").isNull() | (F.col("seq") > F.col("cut.seq"))),
                            F.col("off") + F.col("len"),
                        )
                    ),
                    F.lit(0),
                ),
            )
            .cast("long")
            .alias("size")
        )
    )


def holes(current: DataFrame, sizes: DataFrame) -> DataFrame:
    """ino, file_offset, length of the ranges that no extent covers; they read as zeros."""
    edges = current.select("ino", "file_offset", (F.col("file_offset") + F.col("length")).alias("end")).unionAll(
        sizes.select("ino", F.col("size").alias("file_offset"), F.col("size").alias("end"))
    )
    before = F.coalesce(F.lag("end").over(W.partitionBy("ino").orderBy("file_offset", "end")), F.lit(0))
    return (
        edges.withColumn("from", before)
        .where(F.col("from") < F.col("file_offset"))
        .select("ino", F.col("from").alias("file_offset"), (F.col("file_offset") - F.col("from")).alias("length"))
    )


def read_plan(requests: DataFrame, current: DataFrame, sizes: DataFrame) -> DataFrame:
    """The part of each extent that a read request needs (request_id, ino, off, len), clamped
    to the end of the file: request_id, ino, chunk_id, chunk_offset, length, out_offset."""
    wanted = (
        requests.join(sizes, "ino")
        .withColumn("end", F.least(F.col("off") + F.col("len"), "size"))
        .where("off < end")
        .select("request_id", "ino", "off", "end")
    )
    lo = F.greatest("off", "file_offset")
    hi = F.least("end", F.col("file_offset") + F.col("length"))
    return (
        wanted.join(current, "ino")
        .where((F.col("file_offset") < F.col("end")) & (F.col("file_offset") + F.col("length") > F.col("off")))
        .select(
            "request_id",
            "ino",
            "chunk_id",
            (F.col("chunk_offset") + lo - F.col("file_offset")).alias("chunk_offset"),
            (hi - lo).alias("length"),
            (lo - F.col("off")).alias("out_offset"),
        )
    )


def read_bytes(
    plan: DataFrame, requests: DataFrame, sizes: DataFrame, chunks: DataFrame, cut: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """request_id, data: planned pieces cut out of chunk bytes (chunk_id, content) and laid
    over zeros. One task holds one request's bytes, never a whole file's.

    Where the bytes of a range can be made from other columns of chunks, `cut` makes them from its
    offset and length, once the chunk's row is with the piece: whole contents are not moved."""
    if cut is None:
        chunks = chunks.select("chunk_id", "content")
        cut = lambda off, length: F.substring("content", off + 1, length)
    # Spark takes a content that is computed for a few bytes, and would broadcast it
    pieces = plan.join(chunks.hint("merge"), "chunk_id").select(
        "request_id", "out_offset", cut(F.col("chunk_offset"), F.col("length")).alias("bytes")
    )
    return laid_out(pieces, requests, sizes)


def laid_out(pieces: DataFrame, requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """request_id, data from request_id, out_offset, bytes of the pieces that are not holes."""
    total = (
        requests.join(sizes, "ino", "left")
        .select("request_id", F.greatest(F.least(F.col("off") + F.col("len"), F.coalesce("size", F.lit(0))) - F.col("off"), F.lit(0)).alias("n"))
    )
    end = F.col("out_offset") + F.octet_length("bytes")
    before = F.coalesce(F.lag(end).over(W.partitionBy("request_id").orderBy("out_offset")), F.lit(0))
    zero = lambda n: F.unhex(F.repeat(F.lit("00"), n.cast("int")))
    filled = pieces.select("request_id", "out_offset", end.alias("end"), F.concat(zero(F.col("out_offset") - before), "bytes").alias("bytes"))
    # every piece comes after its own hole, so the bytes of a request are joined once
    joined = filled.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("out_offset", F.hex("bytes").alias("x")))).alias("p"), F.max("end").alias("end"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: x["x"]), ""))
    # the zeros of holes are not in the sizes that Spark knows: no broadcast here either
    return total.join(joined.select("request_id", "end", data.alias("data")).hint("merge"), "request_id", "left").select(
        "request_id", F.concat(F.coalesce("data", F.lit(b"")), zero(F.col("n") - F.coalesce("end", F.lit(0)))).alias("data")
    )


def file_growth(log: DataFrame) -> DataFrame:
    """at, ino, op, off, len, size (of the file after the operation) and growth, if every
    operation is done. log: at (the order over all files), ino, op, off, len."""
    by_file = W.partitionBy("ino").orderBy("at")
    part = log.withColumn("part", F.count(F.when(F.col("op") == "truncate", 1)).over(by_file))
    reach = F.when(F.col("op") == "truncate", F.col("off")).otherwise(F.col("off") + F.col("len"))
    size = F.max(reach).over(W.partitionBy("ino", "part").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    sized = part.withColumn("size", size)
    return sized.withColumn("growth", F.col("size") - F.coalesce(F.lag("size").over(by_file), F.lit(0))).drop("part")


def capacity_rejections(log: DataFrame, capacity: int, lot_ops: int = 1 << 20) -> DataFrame:
    """at, ino, growth of the writes that are refused because the bytes in use by all files and
    the growth of their own would exceed the capacity. Writes that do not grow a file are
    allowed; a refused write changes nothing; truncation frees bytes.

    As long as nothing is refused, the bytes in use are a running sum, within lots of the order
    and over lots. From the first refusal on, each verdict depends on the one before: one task
    reads the rest of the log as a stream, and remembers the sizes of the files in it."""
    spark = log.sparkSession
    log = log.where((F.col("op") == "truncate") | (F.col("len") > 0)).select("at", "ino", "op", "off", "len")
    grown = file_growth(log).withColumn("lot", F.floor(F.col("at") / lot_ops))
    lots = grown.groupBy("lot").agg(F.sum("growth").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("lot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("growth").over(W.partitionBy("lot").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    used = grown.withColumn("own", own).join(lots.select("lot", before.alias("before")), "lot").withColumn("used", F.col("own") + F.col("before"))
    first = used.where((F.col("op") == "write") & (F.col("growth") > 0) & (F.col("used") > capacity)).agg(F.min("at")).first()[0]
    schema = "at long, ino long, growth long"
    if first is None:
        return spark.createDataFrame([], schema)
    start = used.where(F.col("at") < first).agg(F.max_by("used", "at")).first()[0] or 0
    rest = log.where(F.col("at") >= first)
    sizes = grown.where(F.col("at") < first).groupBy("ino").agg(F.max_by("size", "at").alias("off")).join(rest.select("ino").distinct(), "ino", "left_semi")
    known = sizes.select(F.lit(-1).cast("long").alias("at"), "ino", F.lit("size").alias("op"), "off", F.lit(0).cast("long").alias("len"))

    def run(batches):
        size: dict[int, int] = {}
        in_use = start
        for batch in batches:
            out = []
            for at, ino, op, off, n in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                now = size.get(ino, 0)
                if op == "write":
                    if off + n <= now:
                        continue
                    if in_use + off + n - now > capacity:
                        out.append((at, ino, off + n - now))
                        continue
                    off += n
                if op != "size":
                    in_use += off - now
                size[ino] = off
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["at", "ino", "growth"])

    return known.unionByName(rest).repartition(1).sortWithinPartitions("at").mapInArrow(run, schema)
