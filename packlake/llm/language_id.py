"""Language ID: multilingual mixture inference.

Each language has a model of character n-grams (1 to 3, within a word and its edges),
hashed to a fixed number of buckets, learned from texts with a known language. A document
is a mixture: each of its words comes from one language, with the document's own
proportions. Expectation-maximisation estimates the proportions from the words'
likelihoods; languages leave the set one by one, the least used first, while that lowers
the penalised likelihood (BIC: half the log of the number of words for each language).
The prediction is the language with the largest proportion, the score is that proportion.

Learning reads a bounded sample: of the documents whose crc32(doc_id as text) mod 5 is not
0, about `sample` by a hash of doc_id (all if there are fewer), as many of each language.
Every language that has a label is learned; the model has a number for each bucket and
language, at most CELLS (or 1,024 buckets), so with over 512 languages there are fewer buckets.
Prediction reads whole texts of all documents and nothing but the text.

Defined cases: null text or text without a letter gives `und` with score 0, as does every
text if nothing can be learned; ties go to the language that is first by name; repeated
rows are predicted alike; a null doc_id stays null (such rows are not learned from); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidied

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Numbers of a model.
CELLS = 1 << 24
#: Words that a worker remembers, and bytes of their likelihoods.
CACHE_WORDS, CACHE_BYTES = 400_000, 1 << 27
#: Documents whose new words are looked up together, times languages.
SLICE = 4000
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_MULT = np.uint64(0x9E3779B97F4A7C15)

ORACLE_SQL = None


def word_buckets(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words with their edges, all words in one array, and the
    position where each word begins. Each order has hashes of its own."""
    text = "".join(f" {w.lower()} " for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w.lower()) + 2 for w in words), np.int64, len(words))
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(code))
    found, owner = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h[: len(code) - n + 1] = (h[: len(code) - n + 1] ^ code[n - 1 :]) * _MULT
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            whole = at + n <= end  # n-grams do not reach into the next word
            found.append((((h[whole] + np.uint64(n)) * _MULT) >> np.uint64(40)).astype(np.int64) % buckets)
            owner.append(np.repeat(np.arange(len(words)), size)[whole])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    starts = np.searchsorted(owner_all[order], np.arange(len(words)))
    return np.concatenate(found)[order], starts


def learn_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """lang, bucket, n. Each task sends at most one row per language and bucket."""

    def run(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(_LETTERS.findall(text or ""))
        for lang, seen in words.items():
            if not seen:
                continue
            found, starts = word_buckets(list(seen), buckets)
            times = np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), np.diff(starts, append=len(found)))
            n = np.bincount(found, weights=times, minlength=buckets).astype(np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    return (
        docs.select("text", "lang")
        .mapInArrow(tidied(run), "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )


class Model:
    """Languages by name and the log probability of each bucket under each of them."""

    def __init__(self, langs: list[str], log_p: np.ndarray):
        self.langs, self.log_p = langs, log_p  # log_p: buckets x languages


def fit(docs: DataFrame, sample: int = 20_000, smooth: float = 0.5) -> Model:
    """Learn from `docs` (text, lang not null); at most about `sample` documents are read
    into the counts."""
    sizes = {r["lang"]: r["count"] for r in docs.where("lang is not null").groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)))
    buckets = min(BUCKETS, max(1 << 10, 1 << (CELLS // len(sizes)).bit_length() - 1))
    # the same number of each language, so that rare ones are learned too
    each = max(1, sample // len(sizes))
    share = F.create_map(*(x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, each / n)))))
    u = F.shiftrightunsigned(F.xxhash64(F.lit("lang"), "doc_id"), 1).cast("double") / 2.0**63
    drawn = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (u <= F.element_at(share, F.col("lang"))))
    langs = sorted(sizes)
    at = {k: i for i, k in enumerate(langs)}
    n = np.full((buckets, len(langs)), smooth)
    found = learn_counts(drawn, buckets).toArrow()  # bounded: buckets times languages
    for batch in found.to_batches():
        column = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
        n[batch.column(1).to_numpy(), column] += batch.column(2).to_numpy()
    return Model(langs, np.log(n / n.sum(axis=0)))


def mixture(like: np.ndarray, counts: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood by expectation-maximisation. like: words x languages."""
    top = like.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(like - top, -60.0))
    share = np.full(like.shape[1], 1.0 / like.shape[1])
    total = counts.sum()
    for _ in range(rounds):
        joint = p * share
        now = (counts / joint.sum(axis=1)) @ joint / total
        done = np.abs(now - share).max() < 1e-4
        share = now
        if done:
            break
    return share, float(counts @ (np.log(np.maximum((p * share).sum(axis=1), 1e-300)) + top[:, 0]))


def select_languages(like: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of languages by penalised likelihood, and their proportions."""
    live = np.arange(like.shape[1])
    share, log_like = mixture(like, counts)
    penalty = 0.5 * np.log(max(2.0, counts.sum()))
    used = share * counts.sum() >= 1e-3
    if not used.all():  # these would go one by one: without them the likelihood is the same
        live = live[used]
        share, log_like = mixture(like[:, live], counts)
    while len(live) > 1:
        rest = np.delete(np.arange(len(live)), share.argmin())
        next_share, next_like = mixture(like[:, live[rest]], counts)
        if log_like - next_like > penalty:
            break
        live, share, log_like = live[rest], next_share, next_like
    return live, share


class Predictor:
    """Remembers words, up to a bound: known maps a word to its row of likelihoods."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)))

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > min(CACHE_WORDS, CACHE_BYTES // (8 * len(self.model.langs))):
            self.known, self.rows, new = {}, self.rows[:0], list(words)
        if new:
            found, starts = word_buckets(new, len(self.model.log_p))
            # the mean over the orders: each character counts about once
            like = np.add.reduceat(self.model.log_p[found], starts, axis=0) / len(ORDERS)
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, like])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [_LETTERS.findall(x or "") for x in texts]
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        self._learn(set().union(*words))
        out = []
        for found in words:
            if not found:
                out.append((UNKNOWN, 0.0))
                continue
            at = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
            at, counts = np.unique(at, return_counts=True)
            live, share = select_languages(self.rows[at], counts.astype(float))
            best = int(share.argmax())
            out.append((self.model.langs[live[best]], float(min(1.0, share[best]))))
        return out


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, both bounded

    def run(batches):
        predictor = _predictor(shared)
        size = max(1, min(1000, SLICE // max(1, len(shared.value.langs))))
        for batch in (b.slice(at, size) for b in batches for at in range(0, b.num_rows, size)):
            got = predictor.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")


_live: dict = {}


def _predictor(shared) -> Predictor:
    """One per worker and model, so that words met in one task are known in the next."""
    if _live.get("model") is not shared.value:
        _live.update(model=shared.value, predictor=Predictor(shared.value))
    return _live["predictor"]


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
