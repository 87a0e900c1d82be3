"""The storage tables as projections of the driver's star schema (synthetic mappings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import BLOCK_SIZE, ROOT_INO, S_IFDIR, S_IFREG

LANG_BASE, SOURCE_BASE, LABEL_BASE, LINK_BASE = 1_000_000_000, 2_000_000_000, 2_500_000_000, 3_000_000_000
#: Bytes of a stripe of the fixed chunk placement.
STRIPE = 65_536
#: Files that share a lot in distributed running sums.
LOT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ino, seq, op, off, len: the write log; for a truncate, off is the new size."""
    order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    cut = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + 2).cast("long").alias("ino"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.when(cut, "truncate").otherwise("write").alias("op"),
        (F.col("l_partkey") % 16 * 256).cast("long").alias("off"),
        F.when(cut, F.lit(0).cast("long")).otherwise(F.col("l_quantity").cast("long") * 64).alias("len"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inodes of regular files, one per document."""
    ns = F.col("doc_id").cast("long") * 1_000_000_007 + 123_456_789
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 2).cast("long").alias("ino"),
        F.lit(S_IFREG).alias("file_type"),
        F.lit(0o644).alias("mode"),
        F.col("n_chars").cast("long").alias("size"),
        F.floor((F.col("n_chars") + 511) / 512.0).cast("long").alias("blocks"),
        F.lit(BLOCK_SIZE).alias("blksize"),
        ns.alias("mtime_ns"),
    )


def _langs(docs: DataFrame) -> DataFrame:
    # as many rows as there are languages: the global window is over that list
    return docs.select("lang").distinct().select(
        "lang", (LANG_BASE + F.dense_rank().over(W.orderBy("lang"))).cast("long").alias("lang_ino")
    )


def _sources(docs: DataFrame) -> DataFrame:
    return docs.select("lang", "source").distinct().select(
        "lang", "source", (SOURCE_BASE + F.dense_rank().over(W.orderBy("lang", "source"))).cast("long").alias("source_ino")
    )


def dir_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root / language / source / file."""
    docs = table(spark, sf_dir, "documents")
    langs, sources = _langs(docs), _sources(docs)
    return (
        langs.select(F.lit(ROOT_INO).cast("long").alias("parent_ino"), F.col("lang").alias("name"), F.col("lang_ino").alias("child_ino"))
        .unionAll(sources.join(langs, "lang").select("lang_ino", "source", "source_ino"))
        .unionAll(
            docs.join(sources, ["lang", "source"]).select(
                "source_ino", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), (F.col("doc_id") + 2).cast("long")
            )
        )
    )


def hard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second name for labelled files."""
    return table(spark, sf_dir, "labels").select(
        (LABEL_BASE + F.col("quality")).cast("long").alias("parent_ino"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        (F.col("doc_id") + 2).cast("long").alias("child_ino"),
    )


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ino of every directory that the entries name."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return (
        spark.range(1).select(F.lit(ROOT_INO).cast("long").alias("ino"))
        .unionAll(_langs(docs).select("lang_ino"))
        .unionAll(_sources(docs).select("source_ino"))
        .unionAll(labels.select((LABEL_BASE + F.col("quality")).cast("long")).distinct())
    )


def inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ino, file_type, size of files and directories."""
    return files(spark, sf_dir).select("ino", "file_type", "size").unionAll(
        directories(spark, sf_dir).select("ino", F.lit(S_IFDIR), F.lit(0).cast("long"))
    )


def xattr_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ino, seq, name, value (null: removed): labels set two attributes, a zero `toxic` is removed again."""
    labels = table(spark, sf_dir, "labels").withColumn("ino", (F.col("doc_id") + 2).cast("long"))
    one = lambda seq, name, value: labels.select("ino", F.lit(seq).cast("long").alias("seq"), F.lit(name).alias("name"), value.alias("value"))
    return (
        one(1, "user.quality", F.col("quality").cast("string"))
        .unionAll(one(2, "user.toxic", F.col("toxic").cast("string")))
        .unionAll(one(3, "user.toxic", F.lit(None).cast("string")).join(labels.where("toxic = 0").select("ino").distinct(), "ino", "left_semi"))
    )


def symlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select((F.col("page_id") + LINK_BASE).cast("long").alias("ino"), F.col("url").alias("target"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ino, op, ts, arg: reads and changes by users. seq orders by time, then id, within
    the lots of a day, so that no task orders the whole log."""
    kind = (
        F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "write")
        .when(F.col("event_type") == "purchase", "truncate").when(F.col("event_type") == "signup", "create").otherwise("unlink")
    )
    return running_number(table(spark, sf_dir, "events"), F.to_date("ts"), ["ts", "event_id"], "seq").select(
        "seq", (F.col("user_id") + 2).cast("long").alias("ino"), kind.alias("op"), "ts", F.floor("value").cast("long").alias("arg")
    )


def running_number(df: DataFrame, lot, order: list[str], name: str) -> DataFrame:
    """Row numbers over a whole table whose lots follow each other in the order: numbers
    within each lot plus the sizes of the lots before it (one row per lot)."""
    rows = df.withColumn("__lot", lot)
    sizes = rows.groupBy("__lot").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(
        "__lot", F.coalesce(F.sum("__n").over(W.orderBy("__lot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    )
    own = F.row_number().over(W.partitionBy("__lot").orderBy(*order))
    return rows.withColumn("__own", own).join(before, "__lot").withColumn(name, F.col("__own") + F.col("__before")).drop("__lot", "__own", "__before")


def placed_writes(log: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """ino, seq, len, pos (bytes written before, in the order of ino and seq), chunk_seq:
    fixed stripes of the running sum, which is taken within lots of files and over lots."""
    rows = log.where("op = 'write'").select("ino", "seq", "len", F.floor(F.col("ino") / LOT).alias("lot"))
    sums = rows.groupBy("lot").agg(F.sum("len").alias("n"))
    before = sums.select("lot", F.coalesce(F.sum("n").over(W.orderBy("lot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("len").over(W.partitionBy("lot").orderBy("ino", "seq").rowsBetween(W.unboundedPreceding, 0))
    return (
        rows.withColumn("own", own)
        .join(before, "lot")
        .withColumn("pos", F.col("own") - F.col("len") + F.col("before"))
        .select("ino", "seq", "len", "pos", F.floor(F.col("pos") / stripe).cast("long").alias("chunk_seq"))
    )
