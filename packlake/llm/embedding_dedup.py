"""Embedding near-dedup: spherical k-means cells, exact bounds between vectors and cells.

Equal vectors form a class, represented by the smallest vec_id. Unit centroids are fitted
by spherical k-means on a bounded sample; every class belongs to its nearest cell, and the
widest angle in each cell is kept. Cells are put together, or cut by a hash, into blocks of
bounded size. A vector is dealt to every block with a cell that can hold a link of it: by the
triangle inequality on angles, one whose centroid is no farther than the cell's widest angle
and the angle of the threshold together. So every pair at the threshold meets, once, at any
size; the cells only spare work. Vectors without structure are all compared with each other.

A task holds two blocks and multiplies them by tiles, in single precision to find what is
near the threshold and in double precision to decide. What leaves a task is a row per class
and block pair: its links and the smallest class it reaches.

The number of cells is the root of the number of vectors, at most `max_cells`, so
that the broadcast centroids have a bounded size.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components,
link with nothing and are kept; vectors of other than the most common dimension are
compared with those of their own dimension; a repeated row is a copy like any other; an
empty table gives an empty result; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import share_drawn, table, tidied, written
from .components import block_roots, components

THRESHOLD = 0.9
#: Classes in a block: at most BLOCK and BLOCK_BYTES, and not under LEAST_BLOCK for the sake of more tasks.
BLOCK = 8192
LEAST_BLOCK = 1024
BLOCK_BYTES = 1 << 23
TILE = 1024
#: Radians by which bounds are widened against rounding.
SLACK = 1e-6
#: Components of the sample that centroids are fitted on, over all its vectors.
SAMPLE_COMPONENTS = 1_280_000
MAX_CELLS = 4096

ORACLE_SQL = None


def valid_vectors(emb: DataFrame) -> DataFrame:
    """vec_id, dim, vec (little-endian doubles; null if the row can't link), d1, d2 (digest)."""

    def run(batches):
        import xxhash

        for batch in batches:
            dim, vec, d1, d2 = [], [], [], []
            for v in batch.column(1):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                    x = x + 0.0 if np.isfinite(x).all() and x.any() else None  # -0.0 becomes 0.0
                raw = None if x is None else x.tobytes()
                digest = raw and xxhash.xxh3_128_digest(raw)
                dim.append(None if x is None else len(x))
                vec.append(raw)
                d1.append(digest and int.from_bytes(digest[:8], "little", signed=True))
                d2.append(digest and int.from_bytes(digest[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dim, pa.int32()), pa.array(vec, pa.binary()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())],
                ["vec_id", "dim", "vec", "d1", "d2"],
            )

    return emb.select("vec_id", "embedding").mapInArrow(tidied(run), "vec_id long, dim int, vec binary, d1 long, d2 long")


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 4) -> np.ndarray:
    """k unit centroids of unit rows; a cell that loses all its rows keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[at : at + 2048] @ c.T).argmax(axis=1) for at in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def fit_cells(classes: DataFrame, dim: int, n: int, max_cells: int = MAX_CELLS) -> np.ndarray:
    """Centroids from a sample of at most about SAMPLE_COMPONENTS / dim vectors, by a hash of the id."""
    size = max(1, SAMPLE_COMPONENTS // dim)
    share = min(1.0, size / n)
    drawn = classes.where((F.col("dim") == dim) & share_drawn("cells", "rep", share))
    raw = [bytes(r[0]) for r in drawn.orderBy(F.xxhash64("rep"), "rep").limit(size).select("vec").collect()]
    return spherical_kmeans(_unit(raw), max(1, min(max_cells, round(n**0.5)))) if raw else np.zeros((0, dim))


def _angles(raw: list[bytes], c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(raw) @ c.T, -1.0, 1.0))


def assigned(classes: DataFrame, centroids: np.ndarray) -> DataFrame:
    """classes with `cell`, the nearest, and the angle to it; vectors of another dimension have cell -dim."""
    shared = classes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell, angle = -dims.astype(np.int64), np.zeros(len(dims))
            at = np.flatnonzero(dims == c.shape[1]) if len(c) else np.zeros(0, int)
            raw = batch.column(3).to_pylist() if len(at) else []
            for lo in range(0, len(at), 2048):
                part = at[lo : lo + 2048]
                far = _angles([raw[k] for k in part], c)
                cell[part], angle[part] = far.argmin(axis=1), far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], ["rep", "copies", "dim", "vec", "cell", "angle"])

    return classes.select("rep", "copies", "dim", "vec").mapInArrow(
        tidied(run), "rep long, copies long, dim int, vec binary, cell long, angle double"
    )


class Layout:
    """The blocks of cells. A unit is a run of near cells that share a block, or one cell that
    fills one or more. cells: (cell, classes, widest angle) for each cell that has any."""

    def __init__(self, cells: list[tuple[int, int, float]], centroids: np.ndarray):
        n, dim = sum(x[1] for x in cells), max(1, centroids.shape[1])
        size = max(1, min(BLOCK, max(LEAST_BLOCK, n // 8), max(128, BLOCK_BYTES // (8 * dim))))
        known = {c: (m, r) for c, m, r in cells if c >= 0}
        self.order = self._walk(sorted(known), centroids)
        self.reach = np.array([known[c][1] for c in self.order])
        self.starts: list[int] = []  # of units, in order
        parts, held = [], size + 1
        for k, c in enumerate(self.order):
            m = known[c][0]
            if held + m > size:
                self.starts.append(k)
                parts.append(-(-m // size))
                held = 0
            held += m
        unit = np.repeat(np.arange(len(self.starts)), np.diff([*self.starts, len(self.order)]))
        self.unit_of = dict(zip(self.order, unit.tolist(), strict=True))
        self.units = len(parts)
        for c, m, _ in cells:
            if c < 0:
                self.unit_of[c] = len(parts)
                parts.append(-(-m // max(1, min(size, max(128, BLOCK_BYTES // (-8 * c))))))
        self.parts = np.array(parts, np.int64)
        self.first = np.cumsum(self.parts) - self.parts

    @staticmethod
    def _walk(cells: list[int], c: np.ndarray) -> list[int]:
        """The cells, each followed by the nearest that is left."""
        out, left = [], np.array(cells, np.int64)
        while len(left):
            k = int((c[left] @ c[out[-1]]).argmax()) if out else 0
            out.append(int(left[k]))
            left = np.delete(left, k)
        return out

    def near(self, angles: np.ndarray, theta: float) -> np.ndarray:
        """For rows of angles to all centroids, the blocks that may hold a link."""
        cells = angles[:, self.order] <= self.reach + theta + SLACK
        return np.repeat(np.logical_or.reduceat(cells, self.starts, axis=1), self.parts[: self.units], axis=1)


def dealt(placed: DataFrame, layout: Layout, centroids: np.ndarray, threshold: float) -> DataFrame:
    """rep, copies, vec, block and the block pairs (i, j) in which the row is compared."""
    shared = placed.sparkSession.sparkContext.broadcast((layout, centroids))
    theta = float(np.arccos(np.clip(threshold, -1.0, 1.0)))

    def run(batches):
        import xxhash

        at, c = shared.value
        for batch in batches:
            cells = batch.column(2).to_pylist()
            raw = batch.column(3).to_pylist()
            reps = batch.column(0).to_pylist()
            own = np.zeros(len(cells), np.int64)
            for k, (cell, rep) in enumerate(zip(cells, reps, strict=True)):
                u = at.unit_of[cell]
                own[k] = at.first[u] + (xxhash.xxh3_64_intdigest(rep.to_bytes(8, "little", signed=True)) % int(at.parts[u]) if at.parts[u] > 1 else 0)
            for lo in range(0, len(cells), 512):
                part = np.arange(lo, min(lo + 512, len(cells)))
                main = np.array([k for k in part if cells[k] >= 0], np.int64)
                rows, blocks = [], []
                if len(main):
                    r, b = np.nonzero(at.near(_angles([raw[k] for k in main], c), theta))
                    rows.append(main[r])
                    blocks.append(b)
                for k in part:
                    if cells[k] < 0:
                        u = at.unit_of[cells[k]]
                        rows.append(np.full(at.parts[u], k))
                        blocks.append(at.first[u] + np.arange(at.parts[u]))
                row, other = np.concatenate(rows), np.concatenate(blocks)
                mine = own[row]
                for cut in range(0, len(row), 10_000):
                    take = slice(cut, cut + 10_000)
                    took = pa.array(row[take])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(k).take(took) for k in (0, 1, 3)),
                            pa.array(mine[take]),
                            pa.array(np.minimum(mine, other)[take]),
                            pa.array(np.maximum(mine, other)[take]),
                        ],
                        ["rep", "copies", "vec", "block", "i", "j"],
                    )

    return placed.select("rep", "copies", "cell", "vec").mapInArrow(
        tidied(run), "rep long, copies long, vec binary, block long, i long, j long"
    )


def _joined(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest label that each row reaches over edges between row numbers."""
    while True:
        now = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(now, u, low)
        np.minimum.at(now, v, low)
        if (now == label).all():
            return label
        label = now


def compare_blocks(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of the rows of one block (i = j) or between two blocks."""
    i, j = (int(pdf[c].iloc[0]) for c in ("i", "j"))
    x = np.frombuffer(b"".join(pdf["vec"]), "<f8").reshape(len(pdf), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    short = (x / norm[:, None]).astype(np.float32)
    near = np.float32(threshold - (x.shape[1] + 8) * 1.2e-7)  # no rounding of single precision goes farther
    rep, weight, block = (pdf[c].to_numpy(np.int64) for c in ("rep", "copies", "block"))
    order = np.argsort(rep, kind="stable")
    place = np.empty_like(order)  # by the order of reps, so that the smallest place is the smallest rep
    place[order] = np.arange(len(order))
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    links, u, v = np.zeros(len(pdf), np.int64), [], []
    for p in range(0, len(left), TILE):
        for q in range(p if i == j else 0, len(right), TILE):
            a, b = left[p : p + TILE], right[q : q + TILE]
            hit = short[a] @ short[b].T >= near
            same = i == j and p == q
            if same:
                np.fill_diagonal(hit, False)
            a, b = a[hit.any(axis=1)], b[hit.any(axis=0)]
            if not len(a):
                continue
            link = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= threshold
            link &= a[:, None] != b[None, :]
            if not link.any():
                continue
            links[a] += link @ weight[b]
            if not same:
                links[b] += link.T @ weight[a]
            for rows, roots in zip((a, b), block_roots(link, place[a], place[b]), strict=True):
                u.append(rows)
                v.append(order[roots])
    if not u:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("rep", "links", "root")})
    root = rep[order[_joined(np.concatenate(u), np.concatenate(v), place)]]
    some = links > 0
    return pd.DataFrame({"rep": rep[some], "links": links[some], "root": root[some]})


def embedding_dedup(emb: DataFrame, threshold: float = THRESHOLD, max_cells: int = MAX_CELLS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    vectors = written(valid_vectors(emb), "vectors")
    classes = written(
        vectors.where("vec is not null")
        .groupBy("d1", "d2")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec")),
        "vector-classes",
    )
    dims = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    centroids = fit_cells(classes, dims[0], dims[1], max_cells) if dims else np.zeros((0, 1))
    placed = written(assigned(classes, centroids), "cells")
    # at most max_cells rows, and one for each other dimension
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("angle")).orderBy("cell").collect()
    rows = dealt(placed, Layout([tuple(r) for r in cells], centroids), centroids, threshold)
    links = written(
        rows.groupBy("i", "j").applyInPandas(lambda pdf: compare_blocks(pdf, threshold), "rep long, links long, root long"),
        "vector-links",
    )
    joined = components(links.where("root <> rep").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    per_class = links.groupBy("rep").agg(F.sum("links").alias("links")).join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    described = classes.select("d1", "d2", "rep", "copies").join(per_class, "rep", "left")
    return (
        vectors.select("vec_id", "d1", "d2")
        .join(described, ["d1", "d2"], "left")
        .select(
            "vec_id",
            (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
            F.coalesce("component", "rep", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
