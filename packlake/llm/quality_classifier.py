"""Quality classifier: importance resampling.

Two bag-of-hashed-n-gram models are fitted: one of the target (texts labelled good) and
one of the raw corpus (all texts). A document's log importance weight is the summed log
ratio of the two over its n-grams; adding Gumbel noise and keeping the k largest draws k
documents without replacement in proportion to their weights (Gumbel top-k). k is the
number of documents times the share of good ones among the labelled, taken at its upper
confidence limit so that the draw does not cut into clean text.

N-grams are uni- and bigrams of tokens (letters, digits or a run of signs). A token that
repeats the one before it is read as a repetition mark, so the models see repetition.

The k-th largest score is found exactly by refining a histogram of bounded size; neither
scores nor ids are collected. Noise comes from a hash of seed and doc_id.

Defined cases: null or empty text has weight 0 (and its noise) and is never kept; labels
that are null, contradict each other or name no document are ignored; without any good
label every non-empty text is kept with weight 0; repeated rows score alike and are kept
together; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import share_drawn, table, tidied, written

BUCKETS = 1 << 13
SEED = 5
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_REPEAT = "\x00again"
CACHE_TOKENS = 150_000

ORACLE_SQL = None


class _Hashes(dict):
    """Token to 64-bit hash, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= CACHE_TOKENS:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token)
        return h


def ngram_buckets(text: str | None, buckets: int, known: _Hashes) -> np.ndarray:
    """Bucket of every uni- and bigram of a whole text."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    again = np.flatnonzero(h[1:] == h[:-1]) + 1
    h[again] = known[_REPEAT]
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x7F4A7C15))
    pairs ^= pairs >> np.uint64(29)
    return (np.concatenate([h, pairs * np.uint64(0xBF58476D1CE4E5B9)]) >> np.uint64(40)).astype(np.int64) % buckets


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: n-gram counts over all rows and over those with good = 1.
    Each task sends at most one row per bucket."""

    def run(batches):
        known = _Hashes()
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(ngram_buckets(text, buckets, known), minlength=0)
                raw[: len(n)] += n
                if good:
                    target[: len(n)] += n
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    return (
        docs.select("text", "good")
        .mapInArrow(tidied(run), "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def log_ratio(counts: list, buckets: int = BUCKETS, smooth: float = 10.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket, smoothed; zeros if there is no target."""
    raw, target = np.full(buckets, smooth), np.full(buckets, smooth)
    for b, r, t in counts:
        raw[b] += r
        target[b] += t
    if target.sum() <= smooth * buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


#: Columns that scoring adds; the names are not those of a document's own columns.
_WEIGHT, _EMPTY, _SCORE = "__log_weight", "__empty", "__score"


def with_weights(docs: DataFrame, ratio: np.ndarray, columns: list[str], seed: int = SEED) -> DataFrame:
    """Columns of docs (doc_id among them), the log weight, its sum with Gumbel noise, and
    whether the text has no token."""
    at = docs.columns.index("text")
    carried = [docs.columns.index(c) for c in columns]

    def run(batches):
        known = _Hashes()
        for batch in batches:
            weights, none = [], []
            for text in batch.column(at).to_pylist():
                found = ngram_buckets(text, len(ratio), known)
                weights.append(float(ratio[found].sum()))
                none.append(len(found) == 0)
            weight, empty = pa.array(weights, pa.float64()), pa.array(none, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in carried), weight, empty], [*columns, _WEIGHT, _EMPTY]
            )

    fields = [docs.schema.fields[k] for k in carried]
    schema = T.StructType([*fields, T.StructField(_WEIGHT, T.DoubleType()), T.StructField(_EMPTY, T.BooleanType())])
    scored = docs.mapInArrow(tidied(run), schema)
    # uniform in (0, 1) from the top 52 bits of a hash
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 12).cast("double") + 0.5) / float(1 << 52)
    return scored.withColumn(_SCORE, F.col(_WEIGHT) - F.log(-F.log(u)))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 2048) -> float | None:
    """The exact k-th largest value of a double column (None: fewer rows), by passes that
    each count a bounded number of bins."""
    row = df.agg(F.count(column), F.min(column), F.max(column)).first()
    n, lo, hi = row
    if k <= 0 or n < k:
        return None
    above = 0  # rows above hi
    inside = df.select(F.col(column).alias("v"))
    while True:
        within = inside.where((F.col("v") >= lo) & (F.col("v") <= hi))
        step = (hi - lo) / bins
        if step <= 0 or lo + step == lo:
            # a few neighbouring doubles at most: count each value
            for v, c in sorted(within.groupBy("v").count().collect(), reverse=True):
                above += c
                if above >= k:
                    return v
            return lo
        at = F.least(F.floor((F.col("v") - lo) / step), F.lit(bins - 1))
        found = sorted(
            (tuple(r) for r in within.groupBy(at.alias("b")).agg(F.count(F.lit(1)), F.min("v"), F.max("v")).collect()),
            reverse=True,
        )
        for _, c, low, high in found:
            if above + c >= k:
                if low == high:
                    return low
                lo, hi = low, high
                break
            above += c


def _known(labels: DataFrame) -> DataFrame:
    return (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        .where(F.col("lo") == F.col("hi"))
        .select(F.col("doc_id").alias("__id"), F.col("lo").alias("good"))
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = 50_000) -> np.ndarray:
    """The log ratio of the target model to the raw one. The raw model reads all of docs;
    the target model reads at most `sample` labelled good documents, drawn by a hash, so
    that their ids can be broadcast and no text is shuffled."""
    good = _known(labels).where("good = 1")
    n = good.count()
    drawn = good.where(share_drawn("target", "__id", min(1.0, sample / max(n, 1))))
    marked = docs.select("doc_id", "text").join(F.broadcast(drawn.limit(sample)), F.col("doc_id") == F.col("__id"), "left")
    return log_ratio([tuple(r) for r in bucket_counts(marked).collect()])  # bounded: one row per bucket


def scored_with_cut(
    docs: DataFrame, labels: DataFrame, columns: list[str], seed: int = SEED, z: float = 2.0
) -> tuple[DataFrame, float]:
    """Columns of all documents with their scores, written once, and the score of the last one drawn.
    z: standard errors that the share of good texts is raised by."""
    scored = written(with_weights(docs, fit(docs, labels), columns, seed), "scores")
    full = scored.where(~F.col(_EMPTY))
    seen = full.join(_known(labels), F.col("doc_id") == F.col("__id")).agg(F.count("good"), F.sum("good")).first()
    n_lab, n_good = int(seen[0] or 0), int(seen[1] or 0)
    if not n_good:
        return scored, float("-inf")
    n = full.count()
    share, unknown = n_good / n_lab, max(0.0, 1 - n_lab / n)  # only the unlabelled can differ
    share = min(1.0, share + z * (unknown * (share * (1 - share) + 1 / n_lab) / n_lab) ** 0.5)
    cut = kth_largest(full, _SCORE, max(1, round(n * share)))
    return scored, float("-inf") if cut is None else cut


def _drawn(cut: float):
    return ~F.col(_EMPTY) & (F.col(_SCORE) >= F.lit(cut))


def classify(docs: DataFrame, labels: DataFrame, seed: int = SEED, z: float = 2.0) -> DataFrame:
    """doc_id, log_weight, score, kept. labels: doc_id, quality (1 good, 0 bad)."""
    scored, cut = scored_with_cut(docs.select("doc_id", "text"), labels, ["doc_id"], seed, z)
    return scored.select(
        "doc_id", F.col(_WEIGHT).alias("log_weight"), F.col(_SCORE).alias("score"), _drawn(cut).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the draw keeps, with their columns."""
    scored, cut = scored_with_cut(docs, table(spark, sf_dir, "labels"), docs.columns)
    return scored.where(_drawn(cut)).select(*docs.columns)
