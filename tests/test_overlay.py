import random

import pytest
from pyspark.sql import functions as F

from packlake.operators import overlay as ov


def _log(spark, rows):
    return spark.createDataFrame(rows, "ino long, seq long, op string, off long, len long")


def _fold(rows):
    """Independent oracle: byte by byte."""
    owner, size = {}, {}
    for ino, seq, op, off, n in sorted(rows, key=lambda r: (r[0], r[1])):
        f = owner.setdefault(ino, {})
        if op == "truncate":
            for b in [b for b in f if b >= off]:
                del f[b]
            size[ino] = off
        else:
            for b in range(off, off + n):
                f[b] = (seq, b - off)
            size[ino] = max(size.get(ino, 0), off + n)
    return owner, size


def _bytes(rows):
    out = {}
    for r in rows:
        for b in range(r["length"]):
            at = (r["ino"], r["file_offset"] + b)
            assert at not in out
            out[at] = (r["seq"], r["skip"] + b)
    return out


@pytest.mark.parametrize("stripe", [1 << 20, 32])
def test_random_logs_match_a_sequential_fold(spark, stripe):
    r = random.Random(stripe)
    rows = []
    for ino in range(12):
        for seq in range(1, 15):
            cut = r.random() < 0.2
            rows.append((ino, seq, "truncate" if cut else "write", r.randrange(120), 0 if cut else r.randrange(1, 60)))
    owner, size = _fold(rows)
    log = _log(spark, rows)
    got = ov.overlay(log, stripe).collect()
    assert _bytes(got) == {(i, b): v for i, f in owner.items() for b, v in f.items()}
    assert {x["ino"]: x["size"] for x in ov.file_sizes(log).collect()} == size
    covered = {(i, b) for i, f in owner.items() for b in f}
    gaps = {(x["ino"], b) for x in ov.holes(ov.overlay(log), ov.file_sizes(log)).collect() for b in range(x["file_offset"], x["file_offset"] + x["length"])}
    assert gaps == {(i, b) for i, n in size.items() for b in range(n)} - covered


@pytest.mark.parametrize(
    "writes, lengths, size",
    [
        ([(0, 100), (50, 25)], [50, 25, 25], 100),
        ([(0, 100), (100, 100), (50, 25)], [50, 25, 25, 100], 200),
    ],
)
def test_overwrite(spark, writes, lengths, size):
    log = _log(spark, [(2, k + 1, "write", o, n) for k, (o, n) in enumerate(writes)])
    got = ov.overlay(log).orderBy("file_offset").collect()
    assert [x["length"] for x in got] == lengths
    assert ov.file_sizes(log).first()["size"] == size


def test_truncate_and_growth(spark):
    log = _log(spark, [(2, 1, "write", 0, 1024), (2, 2, "truncate", 512, 0), (3, 1, "write", 0, 10), (3, 2, "truncate", 20, 0)])
    got = {x["ino"]: x["length"] for x in ov.overlay(log).collect()}
    assert got == {2: 512, 3: 10}
    assert {x["ino"]: x["size"] for x in ov.file_sizes(log).collect()} == {2: 512, 3: 20}
    hole = ov.holes(ov.overlay(log), ov.file_sizes(log)).collect()
    assert [(x["ino"], x["file_offset"], x["length"]) for x in hole] == [(3, 10, 10)]


def test_read_bytes_fills_holes_with_zeros(spark):
    log = _log(spark, [(2, 1, "write", 0, 4), (2, 2, "write", 8, 4), (2, 3, "truncate", 14, 0)])
    placed = spark.createDataFrame([(2, 1, 0, 0), (2, 2, 4, 0)], "ino long, seq long, pos long, chunk_seq long")
    ext, sizes = ov.extents(log, placed, 65536), ov.file_sizes(log)
    requests = spark.createDataFrame([(1, 2, 2, 100), (2, 2, 9, 2), (3, 2, 50, 5)], "request_id long, ino long, off long, len long")
    chunks = spark.createDataFrame([("chunk-00000000", bytearray(b"abcdEFGH"))], "chunk_id string, content binary")
    plan = ov.read_plan(requests, ext, sizes)
    got = {x["request_id"]: bytes(x["data"]) for x in ov.read_bytes(plan, requests, sizes, chunks).collect()}
    assert got == {1: b"cd\0\0\0\0EFGH\0\0", 2: b"FG", 3: b""}


@pytest.fixture
def small_broadcasts(spark):
    """A broadcast of more than 8 MB is an error."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "8m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_read_bytes_broadcasts_no_contents(spark, small_broadcasts):
    ids = spark.range(32)
    chunk = F.format_string("chunk-%08d", "id").alias("chunk_id")
    chunks = ids.select(chunk, F.encode(F.repeat(F.lit("0123456789abcdef"), 1 << 16), "utf-8").alias("content"))
    plan = ids.select(F.col("id").alias("request_id"), chunk, F.lit(3 << 16).cast("long").alias("chunk_offset"), F.lit(20).cast("long").alias("length"), F.lit(0).cast("long").alias("out_offset"))
    requests = ids.selectExpr("id as request_id", "id as ino", "0L as off", "20L as len")
    sizes = ids.selectExpr("id as ino", "20L as size")
    got = ov.read_bytes(plan, requests, sizes, chunks).collect()
    assert len(got) == 32 and {bytes(x["data"]) for x in got} == {b"0123456789abcdef0123"}


def test_laid_out_broadcasts_no_holes(spark, small_broadcasts):
    ids = spark.range(32)
    n = 1 << 20
    pieces = ids.select(F.col("id").alias("request_id"), F.lit(n - 1).cast("long").alias("out_offset"), F.lit(b"x").alias("bytes"))
    requests = ids.selectExpr("id as request_id", "id as ino", "0L as off", f"{n}L as len")
    sizes = ids.selectExpr("id as ino", f"{n}L as size")
    got = ov.laid_out(pieces, requests, sizes).select(F.octet_length("data").alias("n"), F.expr("substring(data, -2, 2)").alias("end")).collect()
    assert len(got) == 32 and {(x["n"], bytes(x["end"])) for x in got} == {(n, b"\0x")}
