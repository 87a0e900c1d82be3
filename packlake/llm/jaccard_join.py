"""N-gram Jaccard join: MinHash LSH forest.

Texts are sets of word shingles. Equal sets are copies and form a class. Every class has a
MinHash signature, laid out as `TREES` labels of `DEPTH` values; a tree of the forest is the
sorted order of one label over all classes, which is its prefix trie: two classes share a
node at depth k if no two neighbours between them in the order agree in less than k values.
So one sort yields, for each pair of neighbours, the depth of their lowest common node, and
every shorter prefix can be read from it.

Matching starts at the full depth for all. After the exact verification each class has an
estimate of its own recall from the similarities of its links (a link of similarity s is met
at depth k with probability 1 - (1 - s^k)^trees). The prefixes of classes below the target
are shortened by one, for themselves, until each is there; at the depth where a pair at the
threshold itself is met with the target probability every estimate is, so that is the
shortest prefix. A class without a link has no estimate and stays at the full depth, where a
pair at the threshold 0.8 is met with probability 0.9995.

Candidates are never emitted as pairs: neighbours of a trie are edges, their connected
components bring the texts together, and a component is compared in blocks, of which a
task holds two. Within blocks the pairs that share a trie node are verified exactly on
their shingle sets. What leaves a task is a row per class: its links and the smallest
class it reaches.

Defined cases: a text of fewer words than a shingle is one shingle; null, empty and blank
texts link with nothing and are kept; a repeated row is a copy like any other; rows that
share a doc_id but not the text are documents of their own; rows without a doc_id take part,
and name a class only if all of its rows have none (class_id is null, kept is true); an
empty table gives an empty result; other columns are ignored, and carried along by the
pipeline stage, which keeps one row of each class: of the smallest doc_id, nulls last.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import slices, table, tidied, written
from .components import block_roots, blocked, components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH = 32, 7
TARGET_RECALL = 0.9995
#: Bytes of a value in a label.
VALUE = 2
BLOCK = 1024
#: Shingles that are laid out as a matrix at a time.
MAX_SHINGLES = 1_000_000

ORACLE_SQL = None


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of another by place in a word."""
    table = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
    return table, np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes. Words are not empty but for one."""
    table, power = _bytes()
    size = pc.binary_length(words).to_numpy().astype(np.int64)
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        first = words.offset and np.frombuffer(words.buffers()[1], np.int32)[words.offset]
        data = table[np.frombuffer(words.buffers()[2], np.uint8)[first : first + size.sum()]]
        begin = np.cumsum(size) - size
        place = np.arange(len(data)) - np.repeat(begin, size)
        data *= power[place % len(power)] + (place // len(power)).astype(np.uint64)
        out[some] = np.add.reduceat(data, begin[some])
    return _mix(out + size.astype(np.uint64))


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    count = pc.list_value_length(split).to_numpy().astype(np.int64)
    words = split.flatten().dictionary_encode()
    filled = pc.binary_length(words.dictionary).to_numpy() > 0
    at = words.indices.to_numpy()
    kept = filled[at]  # white space at the ends of a text makes empty words
    h = word_hashes(words.dictionary)[at[kept]]
    ends = np.concatenate([[0], np.cumsum(kept)])[np.cumsum(count)]
    begin = np.concatenate([[0], ends[:-1]])
    rolled = {}
    out = []
    for lo, hi in zip(begin.tolist(), ends.tolist(), strict=True):
        size = min(n, hi - lo)
        if not size:
            out.append(np.zeros(0, np.uint64))
            continue
        if size < n:
            acc = _rolled(h[lo:hi], size)
        else:
            if n not in rolled:
                rolled[n] = _rolled(h, n)
            acc = rolled[n][lo : hi - n + 1]
        acc = np.sort(acc)
        out.append(acc[np.concatenate([[True], acc[1:] != acc[:-1]])])
    return out


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
    return _mix(acc)


@lru_cache(maxsize=2)
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(10)
    return rng.integers(0, 1 << 32, n, np.uint32), rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)


def signature(sh: np.ndarray, n: int = TREES * DEPTH) -> np.ndarray:
    """n MinHash values, each cut to 16 bits."""
    flip, mult = _seeds(n)
    high = (sh >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), 256):
        part = high[at : at + 256, None] ^ flip
        part *= mult
        np.minimum(low, part.min(axis=0), out=low)
    return (_mix(low.astype(np.uint64) + np.uint64(1)) >> np.uint64(48)).astype(">u2")  # labels sort by bytes as they do by value


def _text_key():
    """What tells rows apart besides their doc_id."""
    return F.xxhash64(F.col("doc_id").isNull(), "text")


def _row_id():
    """A doc_id that can be compared; nulls have one (and a text key) of their own, and come last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, text_key, d1 and d2 (digest of the shingle set, null without one), sig."""

    def run(batches):
        import xxhash

        for batch in (part for whole in batches for part in slices(whole, 2)):
            d1, d2, sig = [], [], []
            for sh in shingle_sets(batch.column(2), n):
                digest = xxhash.xxh3_128_digest(sh.tobytes()) if len(sh) else None
                d1.append(digest and int.from_bytes(digest[:8], "little", signed=True))
                d2.append(digest and int.from_bytes(digest[8:], "little", signed=True))
                sig.append(signature(sh).tobytes() if digest else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "text_key", "d1", "d2", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), _text_key().alias("text_key"), "text").mapInArrow(
        tidied(run), "doc_id long, text_key long, d1 long, d2 long, sig binary"
    )


def prefix_keys(sig: np.ndarray, depth: int) -> np.ndarray:
    """Trie node of each class in each tree at a depth: classes x TREES hashes."""
    label = sig.reshape(len(sig), TREES, DEPTH)[:, :, :depth].astype(np.uint64)
    acc = np.broadcast_to(np.arange(TREES, dtype=np.uint64) + np.uint64(1), label.shape[:2]).copy()
    for i in range(depth):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + label[:, :, i])
    return acc


def _signatures(binary) -> np.ndarray:
    return np.frombuffer(b"".join(binary), ">u2").reshape(-1, TREES * DEPTH)


def _labels(classes: DataFrame) -> DataFrame:
    """node, tree, label of every class and tree."""
    size = VALUE * DEPTH
    at = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("sig", t * size + 1, F.lit(size)).alias("label")))
    return classes.select("node", F.explode(at).alias("x")).select("node", "x.tree", "x.label")


def _same(a: str, b: str, shortest: int):
    """Leading values in which two labels agree, 0 if fewer than `shortest`."""
    out = F.lit(0)
    for d in range(shortest, DEPTH + 1):
        equal = F.substring(a, 1, VALUE * d) == F.substring(b, 1, VALUE * d)
        out = F.when(equal, F.lit(d)).otherwise(out)
    return out


def forest(classes: DataFrame, shortest: int) -> DataFrame:
    """u, v, depth, tree, label (of u): neighbours in the sorted order of a tree that agree in
    `depth` values, `shortest` at least. A hot label is spread over tasks like any other range;
    the ends of the ranges, two rows of each, are put together afterwards."""

    def run(batches):
        last = None

        def rows(u, v, depth, tree, label):
            return pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), v, pa.array(depth, pa.int32()), pa.array(tree, pa.int32()), pa.array(label, pa.binary())],
                ["u", "v", "depth", "tree", "label"],
            )

        def end(row):
            return rows([row[0]], pa.nulls(1, pa.int64()), [0], [row[1]], [row[2]])

        for batch in batches:
            if not batch.num_rows:
                continue
            node, tree = (batch.column(k).to_numpy() for k in (0, 1))
            label = batch.column(2)
            value = np.frombuffer(b"".join(label.to_pylist()), ">u2").reshape(-1, DEPTH)
            row = (int(node[-1]), int(tree[-1]), label[-1].as_py())
            if last is None:
                yield end((int(node[0]), int(tree[0]), label[0].as_py()))
            else:
                node = np.concatenate([[last[0]], node])
                tree = np.concatenate([[last[1]], tree])
                value = np.concatenate([np.frombuffer(last[2], ">u2")[None, :], value])
            equal = np.logical_and.accumulate(value[1:] == value[:-1], axis=1).sum(axis=1)
            near = np.flatnonzero((equal >= shortest) & (tree[1:] == tree[:-1]))
            yield rows(node[1:][near], pa.array(node[:-1][near]), equal[near], tree[1:][near], [x.tobytes() for x in value[1:][near]])
            last = row
        if last is not None:
            yield end(last)

    ordered = _labels(classes).repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    near = written(
        ordered.mapInArrow(tidied(run), "u long, v long, depth int, tree int, label binary"), "tries"
    )
    # two rows of each range: in their order, each with the one before
    before = W.orderBy("tree", "label", "u")
    ends = near.where("v is null").select(
        "u", F.lag("u").over(before).alias("v"), F.lag("tree").over(before).alias("t"), F.lag("label").over(before).alias("l"), "tree", "label"
    )
    ends = ends.where("tree = t and u <> v").withColumn("depth", _same("label", "l", shortest)).where("depth > 0")
    return near.where("v is not null").unionByName(ends.select(*near.columns))


def meets(s: np.ndarray, depth: int) -> np.ndarray:
    """Probability that a pair of similarity s shares a node at a depth."""
    return 1 - (1 - s**depth) ** TREES


def _candidates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    met = np.zeros((len(a), len(b)), bool)
    for t in range(a.shape[1]):
        met |= a[:, t][:, None] == b[:, t][None, :]
    return met


def _shared(a: list[np.ndarray], b: list[np.ndarray], met: np.ndarray) -> np.ndarray:
    """Number of common shingles of the candidate pairs, exactly."""
    if sum(map(len, a)) + sum(map(len, b)) > MAX_SHINGLES and len(a) + len(b) > 2:
        if len(a) >= len(b):
            half = len(a) // 2
            return np.concatenate([_shared(a[:half], b, met[:half]), _shared(a[half:], b, met[half:])])
        half = len(b) // 2
        return np.concatenate([_shared(a, b[:half], met[:, :half]), _shared(a, b[half:], met[:, half:])], axis=1)
    out = np.zeros(met.shape, np.int64)
    rows, cols = np.nonzero(met)
    if len(rows) <= 4 * (len(a) + len(b)):
        for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
            out[i, j] = len(np.intersect1d(a[i], b[j], assume_unique=True))
        return out
    everything = np.concatenate(a + b)
    who = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    values, column, count = np.unique(everything, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]  # a shingle of one text is shared by none
    who, column = who[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    width = 4096
    acc = np.zeros(met.shape, np.float64)
    for at in range(0, int(count[count > 1].size), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(a) + len(b), width), np.float32)
        x[who[lo:hi], column[lo:hi] - at] = 1
        acc += x[: len(a)] @ x[len(a) :].T
    return acc.astype(np.int64)


def compare_blocks(pdf: pd.DataFrame, depth: int, threshold: float, n: int) -> pd.DataFrame:
    """Links of the rows of one block (i = j) or between two blocks of a component, over pairs
    that meet at this depth and at no greater one, one of them with its prefixes so short.
    `expected` is the number of links that those found stand for, at this depth and each below."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    sets = []
    for batch in slices(pa.RecordBatch.from_arrays([pa.array(pdf["text"], pa.string())], ["text"]), 0):
        sets += shingle_sets(batch.column(0), n)
    values = _signatures(pdf["sig"].tolist())
    node, weight, block = (pdf[c].to_numpy(np.int64) for c in ("node", "copies", "block"))
    short = pdf["short"].to_numpy(bool)
    a = np.flatnonzero(block == i)
    b = a if i == j else np.flatnonzero(block == j)
    keys = prefix_keys(values, depth)
    met = _candidates(keys[a], keys[b]) & (node[a][:, None] != node[b][None, :])
    if depth < DEPTH:
        keys = prefix_keys(values, depth + 1)
        met &= ~_candidates(keys[a], keys[b]) & (short[a][:, None] | short[b][None, :])
    sa, sb = [sets[k] for k in a], [sets[k] for k in b]
    both = _shared(sa, sb, met)
    union = np.array([len(x) for x in sa])[:, None] + np.array([len(x) for x in sb])[None, :] - both
    s = np.where(met, both / np.maximum(union, 1), 0.0)
    link = met & (both >= threshold * union - 1e-9)
    left, right = block_roots(link, node[a], node[b])
    stands = [np.where(link, 1 / meets(np.where(link, s, 1.0), d), 0.0) for d in range(depth, 0, -1)]
    out = [(node[a], link @ weight[b], left, link.sum(axis=1), np.stack([x.sum(axis=1) for x in stands], axis=1))]
    if i != j:
        out.append((node[b], link.T @ weight[a], right, link.sum(axis=0), np.stack([x.sum(axis=0) for x in stands], axis=1)))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    some = columns[3] > 0
    columns = [x[some] for x in columns]
    result = pd.DataFrame({"node": columns[0], "links": columns[1], "root": columns[2], "found": columns[3].astype(float)})
    for d in range(1, DEPTH + 1):
        result[f"expected_{d}"] = columns[4][:, depth - d] if d <= depth else 0.0
    return result


def verified(docs: DataFrame, classes: DataFrame, edges: DataFrame, short: DataFrame | None, depth: int, threshold: float, n: int) -> DataFrame:
    """node, links, root, found, expected by depth: a row per class and block pair with links. edges: neighbours in runs to compare; short: the classes that come so far up."""
    member = components(edges.select("u", "v")).join(classes.select("node", "copies", "sig", "first"), "node")
    if short is None:
        member = member.withColumn("short", F.lit(True))
    else:
        member = member.join(short.select("node", F.lit(True).alias("short")), "node", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    member = member.select("*", F.col("first.id").alias("__id"), F.col("first.text_key").alias("__t")).drop("first")
    texts = docs.select(_row_id().alias("__id"), _text_key().alias("__t"), "text").hint("merge")
    member = written(texts.join(member, ["__id", "__t"]).dropDuplicates(["__id", "__t", "node"]).drop("__id", "__t"), "members")
    return written(
        blocked(member, "component", "node", BLOCK)
        # else the blocks of a component stay in its task; by a number, as bytes do not tell the work
        .repartition(max(1, min(20_000, member.count() // 2 // BLOCK + 1) * 2), "component", "i", "j")
        .groupBy("component", "i", "j")
        .applyInPandas(
            lambda pdf: compare_blocks(pdf, depth, threshold, n),
            ", ".join(["node long, links long, root long, found double", *(f"expected_{d} double" for d in range(1, DEPTH + 1))]),
        ),
        "links",
    )


def shortest_depth(threshold: float, target_recall: float) -> int:
    """The greatest depth at which a pair at the threshold is met with the target probability."""
    good = [d for d in range(DEPTH, 0, -1) if meets(np.array(threshold), d) >= target_recall]
    if not good:
        raise ValueError(f"{TREES} trees can't reach a recall of {target_recall} at a similarity of {threshold}")
    return good[0]


def joined(docs: DataFrame, threshold: float, n: int, target_recall: float) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and for every class d1, d2, first (the row that stands for
    it), copies, links, and least (the smallest of the rows that links reach)."""
    shortest = shortest_depth(threshold, target_recall)
    prints = written(fingerprints(docs, n), "fingerprints")
    # a node's number is that of its row in the stored table
    classes = written(
        prints.where("d1 is not null")
        .groupBy("d1", "d2")
        .agg(
            F.min(F.struct(_row_id().alias("id"), F.col("text_key"))).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            F.any_value("sig").alias("sig"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    tries = written(forest(classes, shortest), "neighbours")
    links = verified(docs, classes, tries.where(F.col("depth") == DEPTH), None, DEPTH, threshold, n)
    for depth in range(DEPTH - 1, shortest - 1, -1):
        # classes that are still short of the target one level below
        seen = links.groupBy("node").agg(F.sum("found").alias("found"), F.sum(f"expected_{depth + 1}").alias("expected"))
        short = written(seen.where(F.col("found") < target_recall * F.col("expected")).select("node"), "short")
        if short.isEmpty():
            break
        run = F.xxhash64("tree", F.substring("label", 1, VALUE * depth)).alias("run")
        runs = _labels(classes.join(short, "node", "left_semi")).select(run).distinct()
        edges = tries.where(F.col("depth") >= depth).withColumn("run", run).join(runs, "run", "left_semi")
        links = links.unionByName(verified(docs, classes, edges, short, depth, threshold, n))
    reached = components(links.where("root <> node").select(F.col("node").alias("u"), F.col("root").alias("v")))
    per_class = links.groupBy("node").agg(F.sum("links").alias("links")).join(reached, "node")
    some = written(classes.drop("sig").join(per_class, "node"), "linked")
    least = written(some.groupBy("component").agg(F.min("first").alias("least")), "least")
    alone = classes.join(per_class, "node", "left_anti").select("d1", "d2", "first", "copies", F.lit(0).cast("long").alias("links"), F.col("first").alias("least"))
    linked = some.join(least, "component").select("d1", "d2", "first", "copies", "links", "least")
    return prints, written(linked.unionAll(alone), "described")


def jaccard_join(
    docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, target_recall: float = TARGET_RECALL
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id that links reach), copy_id
    (smallest doc_id with the same shingle set), n_links (other documents at or above the
    threshold, copies included) and kept (doc_id = class_id)."""
    prints, classes = joined(docs, threshold, n, target_recall)
    known = lambda c: F.when(F.col(c) < (1 << 63) - 1, F.col(c))
    with_set = prints.where("d1 is not null").select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select(
        "doc_id", known("least.id").alias("class_id"), known("first.id").alias("copy_id"), (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links")
    )
    own = F.col("doc_id")
    without = prints.where("d1 is null").select("doc_id", own.alias("class_id"), own.alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return with_set.unionAll(without).withColumn("kept", own.eqNullSafe(F.col("class_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays."""
    prints, classes = joined(docs, THRESHOLD, WORDS, TARGET_RECALL)
    keep = classes.where("first = least").select(F.col("first.id").alias("__id"), F.col("first.text_key").alias("__t"))
    blank = prints.where("d1 is null").select(_row_id().alias("__id"), F.col("text_key").alias("__t")).distinct()
    marked = docs.withColumn("__id", _row_id()).withColumn("__t", _text_key()).hint("merge")
    return marked.join(keep.unionAll(blank), ["__id", "__t"], "left_semi").dropDuplicates(["__id", "__t"]).select(*docs.columns)
