"""Quality rules [native]: cross-document line frequency.

Normalised lines are hashed and counted over the distinct documents of each host
(the document's `source`). A line above the limit is removed from every document but
the first one of its host (the smallest doc_id), so nothing is lost from the corpus;
documents depleted by the removal are rejected. Exact copies count as one document:
a distinct document is a distinct text.

Defined cases: null or empty text has no words and fails the base rules; a null source
is a host of its own; rows without a doc_id count as documents and lose no lines; repeated
rows each get the verdict of one; an empty table gives
an empty result; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE, -1), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once; plain reuse inside a lambda would
    compute it again for every element."""
    return F.transform(F.array(value), body)[0]


def _hash_windows(w: Column) -> Column:
    return F.when(
        F.size(w) >= WINDOW,
        F.transform(
            F.slice(w, F.lit(1), F.size(w) - (WINDOW - 1)),
            lambda h, i: F.xxhash64(h, *(F.get(w, i + k) for k in range(1, WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_starts(sorted_windows: Column) -> Column:
    """Positions of windows that have an equal neighbour in hash order, in text order."""
    flagged = F.transform(
        sorted_windows,
        lambda x, k: F.when(
            ((k > 0) & (F.get(sorted_windows, k - 1)["h"] == x["h"])) | (F.get(sorted_windows, k + 1)["h"] == x["h"]),
            x["i"],
        ),
    )
    return F.array_sort(F.array_compact(flagged))


def repeat_words(windows: Column) -> Column:
    """Words covered by windows that are found twice or more; `windows` is a bound
    array with the hash of each window in text order."""
    starts = _let(
        F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), _repeated_starts
    )
    # in text order each window covers up to WINDOW words, or as many as lie after the one before
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
    )["n"]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered)


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the counts over whole texts; one row per input row."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_key"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")).alias("n_dup_lines"),
        _let(
            F.transform(_words(text), lambda w: F.xxhash64(w)),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"), _let(_hash_windows(w), repeat_words).alias("n_repeat_words")
            ),
        ).alias("m"),
    ).select("doc_id", "text_key", "word_chars", "n_symbols", "n_dup_lines", "m.n_words", "m.n_repeat_words")


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_key (host and normalised line hashed), n_words per line with a word."""
    norm = F.lower(F.regexp_replace(F.trim(F.regexp_replace("line", _SPACE, " ")), "[0-9]+", "0"))
    return (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", "source", F.xxhash64("text").alias("text_key"), F.explode(F.split("text", "\n", -1)).alias("line"))
        .select("doc_id", "source", "text_key", norm.alias("norm"))
        .where(F.col("norm") != "")
        .select(
            "doc_id",
            "text_key",
            F.xxhash64(F.col("source").isNull(), "source", "norm").alias("line_key"),
            (F.length("norm") - F.length(F.translate("norm", " ", "")) + 1).alias("n"),
        )
    )


def quality_rules(docs: DataFrame, limit: int = 10, min_left: float = 0.2) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, removed_words, kept.

    limit: distinct documents of a host that may hold a line. min_left: the share of its
    words that a document must keep after the removal."""
    base = base_metrics(docs)
    lines = written(document_lines(docs), "line-keys")  # narrow: lines are split and hashed once
    frequent = (
        lines.groupBy("line_key")
        .agg(F.countDistinct("text_key").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        .where(F.col("n_docs") > limit)
        .select("line_key", "first_doc")
    )
    # read from a table, it does not come grouped by line, and a hot line can be split
    frequent = written(frequent, "frequent-lines")
    removed = (
        lines.join(frequent, "line_key")
        .where(F.col("doc_id") != F.col("first_doc"))
        .groupBy("doc_id", "text_key")
        .agg(F.sum("n").alias("removed"))
    )
    same = W.partitionBy("doc_id", "text_key")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        base.join(removed, ["doc_id", "text_key"], "left")
        .withColumn("removed_words", F.coalesce((F.col("removed") / F.count(F.lit(1)).over(same)).cast("long"), F.lit(0)))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"),
            "removed_words",
            (~failed & ((F.col("removed_words") == 0) | (left >= min_left * F.col("n_words")))).alias("kept"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ln
  from documents),
p as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from d where len(w) >= 5),
g as (select doc_id, i, array_to_string(w[i:i+4], chr(10)) as win from p),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from g) x where c > 1),
rep as (select doc_id, cast(sum(least(5, i - prev)) as bigint) as n from
  (select doc_id, i, coalesce(lag(i) over (partition by doc_id order by i), i - 5) as prev from r) x group by doc_id),
l as (select doc_id, source, text, lower(regexp_replace(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g')) as norm
      from (select doc_id, source, text, unnest(ln) as x from d) y),
f as (select source, norm, min(doc_id) as first_doc from l group by source, norm having count(distinct text) > 10),
rm as (select l.doc_id, cast(sum(length(l.norm) - length(replace(l.norm, ' ', '')) + 1) as bigint) as n
       from l join f on l.source is not distinct from f.source and l.norm = f.norm and l.doc_id <> f.first_doc group by l.doc_id),
b as (select d.doc_id, cast(len(w) as bigint) as n_words,
        cast(length(translate(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) as bigint) as word_chars,
        cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
        cast(len(ln) - len(list_distinct(ln)) as bigint) as n_dup_lines,
        coalesce(rep.n, 0) as n_repeat_words, coalesce(rm.n, 0) as removed_words
      from d left join rep using (doc_id) left join rm using (doc_id)),
v as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
       (not base_failed and (removed_words = 0 or n_words - removed_words >= 0.2 * n_words)) as kept
from v
"""
