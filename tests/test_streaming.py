from pyspark.sql import functions as F

from packlake.operators import state
from packlake.operators.overlay import overlay
from packlake.schema import OP_LOG
from packlake.sources import fixtures, snapshots
from packlake.streaming import fold

LOG = "ino long, seq long, op string, off long, len long"


def test_persist_folds_names(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "state")
    empty = {f.name: None for f in OP_LOG}
    for k, ops in enumerate(([("create", 2, "a", None)], [("create", 3, "b", None), ("rename", 2, "a", "c")])):
        rows = [tuple((empty | {"seq": 10 * k + i + 1, "ts_ns": 1, "op": o, "ino": n, "parent_ino": 1, "name": m, "dst_parent": 1, "dst_name": d}).values()) for i, (o, n, m, d) in enumerate(ops)]
        spark.createDataFrame(rows, OP_LOG).coalesce(1).write.mode("append").parquet(src)
        q = fold.persist(spark.readStream.schema(OP_LOG).parquet(src), root, str(tmp_path / "ck"))
        q.awaitTermination()
    got = sorted((r["name"], r["child_ino"]) for r in snapshots.load(spark, root)["dir_entries"].collect())
    assert got == [("b", 3), ("c", 2)]
    assert snapshots.current_version(spark, root) == 2


def _ops(spark, ops):
    empty = {f.name: None for f in OP_LOG}
    return spark.createDataFrame([tuple((empty | op).values()) for op in ops], OP_LOG)


def test_state_after_operations(spark, tmp_path):
    ops = [
        {"seq": 1, "ts_ns": 10, "op": "mkdir", "ino": 2, "parent_ino": 1, "name": "d", "mode": 0o755},
        {"seq": 2, "ts_ns": 20, "op": "create", "ino": 3, "parent_ino": 2, "name": "f", "mode": 0o644, "uid": 7},
        {"seq": 3, "ts_ns": 30, "op": "write", "ino": 3, "offset": 0, "length": 100, "chunk_id": "chunk-00000001", "chunk_offset": 0},
        {"seq": 4, "ts_ns": 40, "op": "symlink", "ino": 4, "parent_ino": 1, "name": "l", "dst_name": "/d/f"},
        {"seq": 5, "ts_ns": 50, "op": "setxattr", "ino": 3, "xattr_name": "user.a", "xattr_value": b"x"},
        {"seq": 6, "ts_ns": 60, "op": "link", "ino": 3, "parent_ino": 1, "name": "h"},
        {"seq": 7, "ts_ns": 70, "op": "write", "ino": 3, "offset": 50, "length": 25, "chunk_id": "chunk-00000002", "chunk_offset": 0},
        {"seq": 8, "ts_ns": 80, "op": "setattr", "ino": 3, "size": 60},
        {"seq": 9, "ts_ns": 90, "op": "read", "ino": 3},
        {"seq": 10, "ts_ns": 100, "op": "unlink", "ino": 3, "parent_ino": 2, "name": "f"},
        {"seq": 11, "ts_ns": 110, "op": "removexattr", "ino": 3, "xattr_name": "user.a"},
        {"seq": 12, "ts_ns": 120, "op": "create", "ino": 5, "parent_ino": 2, "name": "gone", "mode": 0o600},
        {"seq": 13, "ts_ns": 130, "op": "write", "ino": 5, "offset": 0, "length": 5, "chunk_id": "chunk-00000002", "chunk_offset": 25},
        {"seq": 14, "ts_ns": 140, "op": "unlink", "ino": 5, "parent_ino": 2, "name": "gone"},
    ]
    want_inodes = {1: (0o040000, 1, 0, 0, 60, 60), 2: (0o040000, 2, 0, 10, 140, 140), 3: (0o100000, 1, 60, 90, 80, 100), 4: (0o120000, 1, 4, 40, 40, 40)}
    for cuts in ([14], [3, 8, 14]):
        tables, at = snapshots.new_tables(spark), 0
        for cut in cuts:
            tables, at = state.apply(tables, _ops(spark, ops[at:cut])), cut
        got = {r["ino"]: (r["file_type"], r["nlink"], r["size"], r["atime_ns"], r["mtime_ns"], r["ctime_ns"]) for r in tables["inodes"].collect()}
        assert got == want_inodes
        assert sorted(map(tuple, tables["extents"].collect())) == [(3, "chunk-00000001", 0, 50, 0), (3, "chunk-00000002", 0, 10, 50)]
        assert sorted(map(tuple, tables["dir_entries"].collect())) == [(1, "d", 2), (1, "h", 3), (1, "l", 4)]
        assert [tuple(r) for r in tables["symlinks"].collect()] == [(4, "/d/f")] and tables["xattrs"].isEmpty()
        assert sorted(map(tuple, tables["chunks"].collect())) == [("chunk-00000001", "Sealed", 100), ("chunk-00000002", "Active", 30)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "state")
    _ops(spark, [{"seq": 1, "ts_ns": 1, "op": "create", "ino": 2, "parent_ino": 1, "name": "a"}]).coalesce(1).write.parquet(src)
    for k in range(2):  # the second run has forgotten what it read
        fold.persist(spark.readStream.schema(OP_LOG).parquet(src), root, str(tmp_path / f"ck{k}")).awaitTermination()
        assert snapshots.current_version(spark, root) == 1
    assert snapshots.load(spark, root)["inodes"].count() == 2


def test_overlay_batches_equal_the_batch_fold(spark, sf, tmp_path):
    log = fixtures.write_log(spark, sf).where("ino < 400")
    src = str(tmp_path / "src")
    for part in ("seq % 2 = 0", "seq % 2 = 1"):
        log.where(part).coalesce(1).write.mode("append").parquet(src)
        q = fold.overlay_batches(spark.readStream.schema(log.schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
    got = fold.latest_extents(spark.read.parquet(str(tmp_path / "out/extents")), spark.read.parquet(str(tmp_path / "out/touched")))
    want = overlay(log)
    assert got.select(*want.columns).exceptAll(want).isEmpty()
    assert want.exceptAll(got.select(*want.columns)).isEmpty()


def test_stateful_sizes(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(2, 1, "write", 0, 10), (2, 2, "truncate", 4, 0), (3, 1, "write", 5, 5)], LOG).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(LOG).parquet(src)
    q = fold.stateful_sizes(stream).writeStream.format("memory").queryName("sizes").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["ino"]: r["size"] for r in spark.sql("select * from sizes").collect()} == {2: 4, 3: 10}
