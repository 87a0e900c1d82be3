"""Column functions of the storage model; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blocks512(size) -> Column:
    """Number of 512-byte blocks, rounded up."""
    return F.floor((col(size) + 511) / 512).cast("long")


def full_mode(file_type, mode) -> Column:
    return col(file_type).bitwiseOR(col(mode).bitwiseAND(F.lit(0o7777)))


def ns_seconds(ns: str) -> Column:
    return F.expr(f"({ns} - pmod({ns}, 1000000000)) div 1000000000")


def ns_rest(ns: str) -> Column:
    return F.expr(f"pmod({ns}, 1000000000)")


def to_ns(sec, nsec) -> Column:
    return col(sec) * F.lit(1_000_000_000).cast("long") + col(nsec)


def ns_timestamp(ns) -> Column:
    """Timestamp at microsecond precision; the raw nanoseconds stay the truth."""
    whole = col(ns) - F.pmod(col(ns), F.lit(1000))  # integers only: nanoseconds do not fit a double
    return F.timestamp_micros(F.call_function("div", whole, F.lit(1000)))


def chunk_id(seq) -> Column:
    return F.format_string("chunk-%08d", col(seq))


def chunk_seq(cid) -> Column:
    """Sequence number of a `chunk-` id of eight digits or more; null for foreign ids."""
    digits = F.regexp_extract(col(cid), r"^chunk-(\d{8,18})$", 1)
    return F.when(digits != "", digits.cast("long"))


def is_object_id(cid) -> Column:
    """Ids that a store accepts."""
    return col(cid).rlike(r"^[A-Za-z0-9._-]+$")


def is_chunk_object(cid, index_key: str = "index.cbor") -> Column:
    """Objects that hold chunks: known id forms, never the index."""
    c = col(cid)
    return (c != index_key) & (chunk_seq(c).isNotNull() | c.rlike(r"^compacted-\d+-\d+$"))


def is_retryable(tier, status) -> Column:
    """Server errors are retried, and refusals by the storage tier; other client errors are not."""
    return (col(status) >= 500) | ((col(tier) == "storage") & (col(status) == 403))


def overlap_start(a, b) -> Column:
    return F.greatest(col(a), col(b))


def overlap_end(a, b) -> Column:
    return F.least(col(a), col(b))
