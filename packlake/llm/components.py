"""Connected components of an edge table, without collecting anything.

Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is two
grouped minima and joins, the number of rounds grows with the log of the longest path,
and no task gathers the neighbours of a node. Lineage is cut every round by a table in
the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Over (u, v), u > v: v's own smallest neighbour takes its place. The rows of a hot v are
    not grouped by it, so that a join can split them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__v"), "m")
    return edges.join(low, F.col("v") == F.col("__v"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Over (u, v), u > v: u and its smaller neighbours all point to the smallest one."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (the smallest node that it reaches) for every node with an edge.

    edges: two long columns u, v in any order; loops and repeats are ignored."""
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = written(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v"), F.col("v")).distinct()
    )


def block_roots(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column of a link matrix reaches."""
    big = np.iinfo(np.int64).max
    while True:
        r = np.minimum(right, np.where(link, left[:, None], big).min(axis=0, initial=big))
        p = np.minimum(left, np.where(link, r[None, :], big).min(axis=1, initial=big))
        if (r == right).all() and (p == left).all():
            return left, right
        left, right = p, r


def blocked(members: DataFrame, group: str, node: str, size: int) -> DataFrame:
    """members with `i`, `j` and `block`: groups are cut into blocks of about `size` by a
    hash of the node, and a row is dealt to every pair of blocks that its own is part of."""
    counts = members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__blocks"))
    cut = members.join(counts, group).withColumn("block", F.pmod(F.xxhash64(node), F.col("__blocks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("__blocks") - 1),
        lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")),
    )
    return cut.withColumn("__p", F.explode(pairs)).select(*members.columns, "block", "__p.i", "__p.j")
