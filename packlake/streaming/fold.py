"""Streaming folds of the operation log.

`persist` applies each micro-batch of changes to versioned tables: data first, then the
pointer. `stateful_sizes` keeps the size of each file as keyed state in the stream itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import state as whole
from ..operators.overlay import overlay
from ..sources import snapshots
from ..sources.shared import stored

APPLIED = "seq long"


def persist(log: DataFrame, root: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Fold a stream of operations (columns of OP_LOG) into snapshots at root: all tables of the
    file system, data first and the pointer last. A version tells the last operation in it, so
    a batch that is replayed after its version was published changes nothing, and one that
    changes nothing publishes nothing."""

    def apply(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        state = snapshots.load_or_empty(spark, root)
        done = snapshots.load_extra(spark, root, "applied", APPLIED)
        last = done.agg(F.max("seq")).first()[0] if done is not None else None
        fresh = stored(batch if last is None else batch.where(F.col("seq") > last))
        if fresh.isEmpty():
            return
        tables = whole.apply(state, fresh)
        clean = snapshots.current_version(spark, root) is not None
        if clean and not any(snapshots.is_dirty(state[k], tables[k]) for k in tables):
            return
        snapshots.save(spark, root, tables | {"applied": fresh.agg(F.max("seq").alias("seq"))})

    writer = log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()


def overlay_batches(log: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Append a write stream to `root/log` and keep `root/extents` of the files it touched:
    only the files of a batch are folded again."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/log/batch={epoch}")
        batch.select("ino").distinct().write.mode("overwrite").parquet(f"{root}/touched/batch={epoch}")
        touched = spark.read.parquet(f"{root}/touched/batch={epoch}")
        whole = spark.read.parquet(f"{root}/log").drop("batch").join(touched, "ino", "left_semi").dropDuplicates(["ino", "seq"])
        overlay(whole).write.mode("overwrite").parquet(f"{root}/extents/batch={epoch}")

    return (
        log.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_extents(extents: DataFrame, touched: DataFrame) -> DataFrame:
    """Extents of each file from the last batch that touched it, which may have left none."""
    last = touched.groupBy("ino").agg(F.max("batch").alias("batch"))
    return extents.join(last, ["ino", "batch"], "left_semi").drop("batch")


def stateful_sizes(log: DataFrame) -> DataFrame:
    """ino, size after each micro-batch that touches a file: the state is one number a file,
    and a sequence number that makes replays harmless."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, seen = state.get if state.exists else (0, -1)
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if row.seq <= seen:
                continue
            seen = int(row.seq)
            size = int(row.off) if row.op == "truncate" else max(size, int(row.off) + int(row.len))
        state.update((size, seen))
        yield pd.DataFrame({"ino": [key[0]], "size": [size]})

    return log.groupBy("ino").applyInPandasWithState(
        step, "ino long, size long", "size long, seen long", "update", GroupStateTimeout.NoTimeout
    )
