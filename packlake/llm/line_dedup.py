"""Line dedup: log-template tree.

Every line walks a tree of fixed depth: first its number of tokens, then its leading
tokens (tokens with a digit are variable fields, `<*>`). In the leaf it joins the template
that it equals in the largest share of tokens, if that is at least `similarity`; positions
that differ become variable. A template found in `min_docs` documents or more recurs, one of
`long_tokens` tokens or more in `long_docs` documents (a passage of that length is not met
twice by chance): its lines are dropped from every document but the first that has it (the
smallest doc_id), so that each text survives once. A document of which no line is left is
rejected. The pipeline stage leaves long templates of just two documents alone where they make
up `COPY_SHARE` or more of the characters of both: those are near copies, which the join after
it finds whole and not by what is left of them.

Only leaves that several documents reach can hold a recurring template, so a count of hashed
leaves goes first, into a filter of fixed size, and only the lines that pass it travel with
their text. Within a leaf the distinct lines are read, not the occurrences. A line of a
template agrees with the line that began it in all but a known number of tokens, so when the
tokens after the leading ones are cut into one segment more than that, both share a segment.
A leaf with more than `leaf_lines` distinct lines is parted into the groups that shared
segments connect: no line can join a template of another group, and templates are the same
whether a leaf is parted or not. A group that stays connected is read by one task.

Defined cases: null and empty texts have no lines and are rejected; blank lines, lines of
fewer than `min_tokens` tokens and lines of variable fields only are never dropped; rows
that share a doc_id count as one document; an empty table gives an empty result; other
columns are carried along by the pipeline stage.
"""

from __future__ import annotations

import re
from collections import defaultdict
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidied, written
from .components import components
from .packing import split_words

DEPTH = 3
SIMILARITY = 0.8
MIN_DOCS = 3
MIN_TOKENS = 3
LONG_TOKENS = 50
LONG_DOCS = 2
COPY_SHARE = 0.3
LEAF_LINES = 20_000
VARIABLE = "<*>"
#: Slots of the filter of leaves; a broadcast bit each.
SLOTS = 1 << 27
_DIGIT = re.compile("[0-9]")

ORACLE_SQL = None


def parse_lines(text: str, depth: int, min_tokens: int):
    """(line number, characters, tokens, leaf) of the lines that may be dropped."""
    for k, raw in enumerate(text.split("\n")):
        tokens = split_words(raw)
        if len(tokens) < min_tokens:
            continue
        if _DIGIT.search(raw):
            tokens = [VARIABLE if _DIGIT.search(x) else x for x in tokens]
            if tokens.count(VARIABLE) == len(tokens):
                continue
        yield k, len(raw), tokens, xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join(tokens[:depth])}")


def docs_needed(long, min_docs: int, long_docs: int):
    """The documents from which on a template recurs."""
    return F.when(long, long_docs).otherwise(min_docs)


def busy_slots(
    docs: DataFrame, depth: int, min_docs: int, min_tokens: int, long_tokens: int, long_docs: int, slots: int = SLOTS
) -> bytes:
    """One bit for each slot of leaf hashes: whether enough lines of different documents fall
    into it. The size is fixed; with very many leaves more slots are busy and let more lines
    through, and what comes after is exact."""

    def run(batches):
        at, owner, long = [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is not None and text:
                    found = [(h % slots, len(tokens)) for _, _, tokens, h in parse_lines(text, depth, min_tokens)]
                    slot, size = np.array(found, np.int64).reshape(-1, 2).T
                    at.append(slot)
                    owner.append(np.full(len(found), doc, np.int64))
                    long.append(size >= long_tokens)
        if not any(map(len, at)):
            return
        at, owner, long = np.concatenate(at), np.concatenate(owner), np.concatenate(long)
        order = np.lexsort((owner, at))
        at, owner, long = at[order], owner[order], long[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        columns = at[first], last - first + 1, owner[first], owner[last], np.logical_or.reduceat(long, first)
        for k in range(0, len(first), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[k : k + 100_000]) for x in columns], ["slot", "n", "lo", "hi", "long"]
            )

    words = (
        docs.select("doc_id", "text")
        .mapInArrow(tidied(run), "slot long, n long, lo long, hi long, long boolean")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("long").alias("long"))
        .where((F.col("n") >= docs_needed(F.col("long"), min_docs, long_docs)) & (F.col("lo") < F.col("hi")))
        .groupBy(F.shiftright("slot", 5).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
    )
    out = np.zeros(slots // 32, "<u4")
    found = words.toArrow()  # at most slots / 32 rows
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def busy_lines(docs: DataFrame, bits: bytes, depth: int, min_tokens: int) -> DataFrame:
    """doc_id, text_key, line, share (of the text's characters), leaf, norm (masked line) of the
    lines in busy slots."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        busy = shared.value
        slots = 8 * len(busy)
        for batch in batches:
            docs_, keys, lines, shares, leaves, norms = [], [], [], [], [], []
            for doc, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if doc is None:
                    continue
                for k, size, tokens, leaf in parse_lines(text or "", depth, min_tokens):
                    slot = leaf % slots
                    if busy[slot >> 3] >> (slot & 7) & 1:
                        docs_.append(doc)
                        keys.append(key)
                        lines.append(k)
                        shares.append(size / len(text))
                        leaves.append(leaf - (1 << 63))
                        norms.append(" ".join(tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs_, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(lines, pa.int32()),
                    pa.array(shares, pa.float32()),
                    pa.array(leaves, pa.int64()),
                    pa.array(norms, pa.string()),
                ],
                ["doc_id", "text_key", "line", "share", "leaf", "norm"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        tidied(run), "doc_id long, text_key long, line int, share float, leaf long, norm string"
    )


def least_votes(n: int, similarity: float) -> int:
    """The fewest equal tokens of n with which a line joins a template."""
    return next(m for m in range(n + 1) if m >= similarity * n or m == n)


def segments(tokens: list[str], similarity: float, depth: int) -> list[tuple]:
    """Runs of tokens after the first `depth`, one more than tokens may differ. Lines that
    are alike enough share one; if all the tokens may differ, there is one run of none."""
    n = len(tokens)
    runs, rest = n - least_votes(n, similarity) + 1, max(0, n - depth)
    if rest < runs:
        return [(n,)]
    cuts = [n - rest + rest * k // runs for k in range(runs + 1)]
    return [(n, k, *tokens[cuts[k] : cuts[k + 1]]) for k in range(runs)]


def templates_of_leaf(lines: list[str], similarity: float, depth: int = 0) -> list[int]:
    """The template of each line (all with as many tokens, the first `depth` the same): the
    number of the line that began it. Lines are taken in the given order."""
    templates: dict[int, list[str | None]] = {}
    holders: dict[tuple, list[int]] = defaultdict(list)  # segments of the lines that began templates
    out = []
    for k, line in enumerate(lines):
        tokens = line.split(" ")
        own = segments(tokens, similarity, depth)
        near = {t for x in own for t in holders.get(x, ())}
        votes = ((sum(map(eq, templates[t], tokens)), -t) for t in near)
        best, first = max(votes, default=(-1, 0))
        if best < similarity * len(tokens):
            templates[k] = list(tokens)
            for x in own:
                holders[x].append(k)
            out.append(k)
            continue
        out.append(-first)
        kept = templates[-first]
        for at, token in enumerate(tokens):
            if kept[at] != token:
                kept[at] = None
    return out


def connected(shapes: DataFrame, similarity: float, depth: int) -> DataFrame:
    """norm_key, deep of the lines of shapes: lines of a leaf that shared segments connect."""

    def run(batches):
        for batch in batches:
            keys, shared = [], []
            for leaf, norm, key in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for x in segments(norm.split(" "), similarity, depth):
                    keys.append(key)
                    shared.append(xxhash.xxh3_64_intdigest(" ".join(map(str, (leaf, *x)))) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(shared, pa.int64())], ["u", "v"])

    keyed = shapes.select("leaf", "norm", F.xxhash64("norm").alias("norm_key"))
    found = components(keyed.mapInArrow(tidied(run), "u long, v long"))
    return keyed.select("norm_key").join(found.withColumnRenamed("node", "norm_key"), "norm_key").select(
        "norm_key", F.col("component").alias("deep")
    )


def line_templates(shapes: DataFrame, similarity: float, depth: int, leaf_lines: int) -> DataFrame:
    """norm_key, template (of lines with the same leaf) from leaf, norm and n (occurrences).
    A partition holds whole groups in order, and its lines are read group by group."""
    shapes = written(shapes, "shapes")
    full = written(shapes.groupBy("leaf").count().where(F.col("count") > leaf_lines).select("leaf"), "full-leaves")
    rows = shapes.withColumn("norm_key", F.xxhash64("norm")).withColumn("deep", F.lit(0).cast("long"))
    if not full.isEmpty():
        parts = connected(shapes.join(full, "leaf", "left_semi"), similarity, depth)
        rows = rows.drop("deep").join(parts, "norm_key", "left").withColumn("deep", F.coalesce("deep", F.lit(0)))

    def run(batches):
        held, lines, keys = None, [], []

        def closed():
            found = templates_of_leaf(lines, similarity, depth)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([keys[t] for t in found], pa.int64())], ["norm_key", "template"]
            )

        for batch in batches:
            for leaf, deep, norm, key in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (leaf, deep) != held:
                    if keys:
                        yield closed()
                    held, lines, keys = (leaf, deep), [], []
                lines.append(norm)
                keys.append(key)
        if keys:
            yield closed()

    ordered = rows.repartition("leaf", "deep").sortWithinPartitions("leaf", "deep", F.desc("n"), "norm")
    return ordered.select("leaf", "deep", "norm", "norm_key").mapInArrow(tidied(run), "norm_key long, template long")


def near_copies(named: DataFrame, pairs: DataFrame, copy_share: float) -> DataFrame:
    """first_doc, last_doc, n_docs of the two documents of templates that make up at least a
    share of both."""
    two = ["first_doc", "last_doc", "n_docs"]
    return (
        named.join(pairs, "template")
        .groupBy(*two, "doc_id", "text_key")
        .agg(F.sum("share").alias("share"))
        .groupBy(*two)
        .agg(F.min("share").alias("share"))
        .where(F.col("share") >= copy_share)
        .select(*two)
    )


def dropped_lines(
    docs: DataFrame,
    depth: int = DEPTH,
    similarity: float = SIMILARITY,
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    leaf_lines: int = LEAF_LINES,
    long_tokens: int = LONG_TOKENS,
    long_docs: int = LONG_DOCS,
    copy_share: float | None = None,
) -> DataFrame:
    """doc_id, text_key, drop (line numbers) of documents that lose lines."""
    bits = busy_slots(docs, depth, min_docs, min_tokens, long_tokens, long_docs)
    found = written(busy_lines(docs, bits, depth, min_tokens), "lines")
    shapes = found.groupBy("leaf", "norm").agg(F.count(F.lit(1)).alias("n"))
    long = F.size(F.split("norm", " ")) >= long_tokens
    named = found.select("doc_id", "text_key", "line", "share", F.xxhash64("norm").alias("norm_key"), long.alias("long")).join(
        line_templates(shapes, similarity, depth, leaf_lines), "norm_key"
    )
    named = written(named.select("doc_id", "text_key", "line", "share", "template", "long"), "templates")
    recurring = (
        named.groupBy("template")
        .agg(
            F.countDistinct("doc_id").alias("n_docs"),
            F.min("doc_id").alias("first_doc"),
            F.max("doc_id").alias("last_doc"),
            F.max("long").alias("long"),
        )
        .where(F.col("n_docs") >= docs_needed(F.col("long"), min_docs, long_docs))
        .drop("long")
    )
    # read from a table, it does not come grouped by template, and a hot template can be split
    recurring = written(recurring, "recurring")
    if copy_share is not None:
        copies = near_copies(named, recurring.where((F.col("n_docs") == 2) & (F.col("n_docs") < min_docs)), copy_share)
        recurring = recurring.join(copies, ["first_doc", "last_doc", "n_docs"], "left_anti")
    return (
        named.join(recurring.select("template", "first_doc"), "template")
        .where(F.col("doc_id") != F.col("first_doc"))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("line").alias("drop"))
    )


#: Columns that the operator adds; the names are not those of a document's own columns.
_LINES, _DROPPED, _KEPT = "__n_lines", "__n_dropped", "__kept"


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """All columns of docs with the remaining text, the number of lines and of dropped lines,
    and whether a line with a word is left."""
    own = docs.columns
    drop = dropped_lines(docs, **options).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("drop").alias("__drop")
    )
    joined = docs.withColumn("__text_key", F.xxhash64("text")).hint("merge").join(
        drop, (F.col("doc_id") == F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left"
    )
    at = own.index("text")

    def run(batches):
        for batch in batches:
            texts, totals, gone, kept = [], [], [], []
            for text, drops in zip(batch.column(at).to_pylist(), batch.column(len(own)).to_pylist(), strict=True):
                n = 0 if text is None else text.count("\n") + 1
                if drops:
                    out = set(drops)
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in out)
                texts.append(text)
                totals.append(n)
                gone.append(len(drops or ()))
                kept.append(bool(text and text.strip(" \t\n\x0b\x0c\r")))
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.bool_())],
                [*own, _LINES, _DROPPED, _KEPT],
            )

    added = [T.StructField(_LINES, T.LongType()), T.StructField(_DROPPED, T.LongType()), T.StructField(_KEPT, T.BooleanType())]
    return joined.select(*own, "__drop").mapInArrow(tidied(run), T.StructType([*docs.schema.fields, *added]))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text (what remains), n_lines, n_dropped, kept of every row."""
    out = cleaned(docs.select("doc_id", "text"), **options)
    return out.withColumnsRenamed({_LINES: "n_lines", _DROPPED: "n_dropped", _KEPT: "kept"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their recurring lines, near copies of one document
    left to the join; n_chars follows the text."""
    out = cleaned(docs, copy_share=COPY_SHARE).where(_KEPT)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
