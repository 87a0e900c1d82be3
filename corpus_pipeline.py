"""A training corpus from raw documents: the stages in order, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all
but the last return the columns of documents, the last returns the pieces of sequences.

Defined cases: documents of null, empty or blank text are rejected by the first two stages;
a null doc_id is an id like any other; of rows that share doc_id and text one stays (they are
copies), and rows that share an id but not the text are documents of their own; a text is
never cut, however long; other columns, of any name, are carried along; empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packlake.llm import jaccard_join, line_dedup, packing, quality_classifier, source_mixing
from packlake.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return quality_classifier.stage(spark, docs, sf_dir)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs."""
    return line_dedup.stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard_join.stage(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return source_mixing.stage(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences: in the order of the mixture by windows, along the
    Hilbert curve within them."""
    return packing.stage(spark, docs, sf_dir)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixing),
    ("packing", packed),
]

#: Not expressible in SQL (fitted models, tokenizer ids); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    out = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out, f"stage-{k}")
    return out
