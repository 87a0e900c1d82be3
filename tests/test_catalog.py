"""Every registered query with oracle SQL agrees with DuckDB at the smallest scale."""

import os
import re

import duckdb
import pytest

from packlake.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


def _rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_oracle(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(catalog.ORACLE_SQL[name])
    want = _rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want


def test_range_read_bytes_moves_no_contents(spark, sf):
    """Chunks are joined by their sizes, and the digits of a range are made after it: what is
    broadcast or shuffled holds no content of a chunk."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = catalog.QUERIES["range_read_bytes"](spark, sf)._jdf.queryExecution().explainString(mode)
    moved = re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]", text)
    assert any("chunk_offset" in x for x in moved)
    assert not any("content" in x for x in moved)


def test_every_query_has_rows_or_is_a_check(spark, sf):
    for name in ("capacity_rejections", "compaction_pack", *(k for k in catalog.QUERIES if k.startswith("broken_"))):
        assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
