"""Mixing sources to target weights: Pfair scheduling.

The documents of a source, in an order drawn by a hash, are cut into blocks of
`block_docs` (the last one may be shorter). Time is a row of slots that hold one block
each. With target weight w, the j-th block of a source is released at floor((j - 1) / w)
and due at ceil(j / w); in every slot the released block with the earliest deadline runs
(ties: the larger weight, then the source's name). At any time each source has had its
share of the slots to within one block. When a source runs out, the rest go on with their
weights from that slot as a new start: nothing is dropped or repeated.

Weights are whole numbers that add up to about `PERIOD`, so the arithmetic is exact, and
after as many slots as their sum every source has had exactly its weight in blocks and the
schedule begins again. So one period for each set of sources that are still there is all
that is simulated, whatever the size of the table; the slot of a block follows from it by
division. A source of a smaller share than one in PERIOD gets a weight of 1.

The plan depends on one row per source, which the driver reads. Ranks within a source are
exact and distributed: rows are dealt by ranges of a hash, counted by source and range, and
numbered on from the counts before them, so a source that holds a third of all rows is
spread over many tasks.

In the pipeline the stage's output lies in its files in the order of the mixture, and
packing keeps to that order window by window (see packing.py).

Defined cases: a null source is a source of its own; a null doc_id is an id like any other;
sources without a target weight, or with one that is not positive, get the smallest positive
one; repeated rows are mixed like any others (the stage puts rows that share an id next to
each other); an empty table gives an empty result; other columns are ignored, and carried
along by the pipeline stage.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import range_part, table

BLOCK_DOCS = 64
#: What the whole weights of all sources add up to, about: the slots that are simulated.
PERIOD = 20_000
SEED = 7
#: Target weights by default: the power of a source's size that flattens large sources.
POWER = 0.5

ORACLE_SQL = None


def _released(weights: Mapping[str, int]) -> Iterator[str]:
    """The source of each slot by earliest deadline first, without end."""
    total = sum(weights.values())
    ready: list = []  # released blocks by deadline; later ones by release time
    waiting = [(0, k, 1) for k in sorted(weights)]
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // weights[k]), -weights[k], k, j))
        _, _, k, j = heapq.heappop(ready)  # the shares add up to one, so there always is one
        yield k
        heapq.heappush(waiting, (j * total // weights[k], k, j + 1))
        slot += 1


def schedule(blocks: Mapping[str, int], weights: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block number from 0) of each slot: the definition, slot by slot."""
    left = {k: n for k, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    while left:
        for k in _released({k: weights[k] for k in left}):
            yield k, done[k]
            done[k] += 1
            left[k] -= 1
            if not left[k]:
                del left[k]
                break  # the rest start anew with a larger share


def whole_weights(sizes: Mapping[str, int], target: Mapping[str, float] | None, power: float = POWER) -> dict[str, int]:
    """Target weights as whole numbers that add up to about PERIOD."""
    raw = {k: (target.get(k, 0.0) if target is not None else n**power) for k, n in sizes.items()}
    good = [x for x in raw.values() if x > 0 and math.isfinite(x)]
    low = min(good, default=1.0)
    raw = {k: x if x > 0 and math.isfinite(x) else low for k, x in raw.items()}
    top = max(raw.values(), default=1.0)  # against overflow of the sum
    scale = PERIOD / sum(x / top for x in raw.values()) if raw else 1.0
    return {k: max(1, round(x / top * scale)) for k, x in raw.items()}


class Plan:
    """The slot of every block of every source. A phase lasts until a source runs out; of each
    phase it holds where it begins and, by source, the slots of one period and the first block."""

    def __init__(self, blocks: Mapping[str, int], weights: Mapping[str, int]):
        self.phases: dict[str, list[tuple[int, int, int, np.ndarray]]] = {k: [] for k in blocks}
        left = {k: n for k, n in blocks.items() if n > 0}
        done, start = dict.fromkeys(left, 0), 0
        while left:
            g = math.gcd(*(weights[k] for k in left))
            share = {k: weights[k] // g for k in left}
            slots: dict[str, list[int]] = {k: [] for k in left}
            period = sum(share.values())
            for at, k in zip(range(period), _released(share), strict=False):
                slots[k].append(at)
            whole = min((left[k] - 1) // share[k] for k in left)  # periods in which no source runs out
            end = min(slots[k][left[k] - whole * share[k] - 1] for k in left if left[k] <= (whole + 1) * share[k])
            for k in list(left):
                own = np.array(slots[k])
                self.phases[k].append((done[k], start, period, own))
                took = whole * share[k] + int(np.searchsorted(own, end, "right"))
                done[k] += took
                left[k] -= took
                if not left[k]:
                    del left[k]
            start += whole * period + end + 1

    def slots(self, source: str, block: np.ndarray) -> np.ndarray:
        phases = self.phases[source]
        at = np.searchsorted([p[0] for p in phases], block, "right") - 1
        out = np.zeros(len(block), np.int64)
        for k, (first, start, period, own) in enumerate(phases):
            here = at == k
            x = block[here] - first
            out[here] = start + x // len(own) * period + own[x % len(own)]
        return out


def _key() -> F.col:
    """A source's name, apart for null."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))


def ranked(docs: DataFrame, seed: int = SEED, range_rows: int = 200_000) -> DataFrame:
    """The rows of docs with `__k` (source key) and `__rank` (from 0, within the source)."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    # rows are dealt by the hash alone: every range holds its share of every source
    keyed = docs.withColumn("__k", _key()).withColumn("__h", h)
    n = docs.select("doc_id").count()
    # fine ranges, so that the groups of a hot source even out over tasks
    parts = max(1, min(20_000, max(n // range_rows, min(n // 100, 1000))))
    # the hash is uniform, so equal steps are its quantiles
    step = (1 << 64) // parts
    bounds = [-(1 << 63) + step * i for i in range(1, parts)]
    keyed = keyed.withColumn("__p", range_part(F.col("__h"), bounds).cast("int") if bounds else F.lit(0))
    counts = keyed.groupBy("__k", "__p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        "__k",
        "__p",
        (F.sum("n").over(W.partitionBy("__k").orderBy("__p").rowsBetween(W.unboundedPreceding, -1))).alias("__before"),
    )
    local = F.row_number().over(W.partitionBy("__k", "__p").orderBy("__h", "doc_id"))
    return (
        keyed.withColumn("__local", local)
        .join(before, ["__k", "__p"])
        .withColumn("__rank", F.coalesce("__before", F.lit(0)) + F.col("__local") - 1)
        .drop("__h", "__p", "__local", "__before")
    )


def plan(docs: DataFrame, target: Mapping[str, float] | None, block_docs: int, power: float = POWER) -> Plan:
    want = None if target is None else {f"s{k}" if k is not None else "n": v for k, v in target.items()}
    sizes = dict(docs.groupBy(_key().alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per source
    return Plan({k: -(-n // block_docs) for k, n in sizes.items()}, whole_weights(sizes, want, power))


def mixed(
    docs: DataFrame,
    target: Mapping[str, float] | None = None,
    block_docs: int = BLOCK_DOCS,
    power: float = POWER,
    seed: int = SEED,
) -> DataFrame:
    """The rows of docs with `block` (of its source), `slot` and `position` (slot and place in the block)."""
    shared = docs.sparkSession.sparkContext.broadcast(plan(docs, target, block_docs, power))

    @F.pandas_udf("long")
    def slot_of(key: pd.Series, block: pd.Series) -> pd.Series:
        out = np.zeros(len(key), np.int64)
        blocks = block.to_numpy(np.int64)
        for k, at in key.groupby(key).indices.items():
            out[at] = shared.value.slots(k, blocks[at])
        return pd.Series(out)

    return (
        ranked(docs, seed)
        .withColumn("block", F.floor(F.col("__rank") / block_docs))
        .withColumn("slot", slot_of("__k", "block"))
        .withColumn("position", F.col("slot") * block_docs + F.col("__rank") % block_docs)
        .drop("__k", "__rank")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs).select("doc_id", "source", "block", "slot", "position")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, sorted by their position in the mixture."""
    at = mixed(docs.select("doc_id", "source")).groupBy(F.col("doc_id").alias("__id")).agg(F.min("position").alias("__at"))
    joined = docs.hint("merge").join(at, F.col("doc_id").eqNullSafe(F.col("__id")))
    return joined.orderBy("__at").select(*docs.columns)
