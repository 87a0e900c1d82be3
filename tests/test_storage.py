import os
import random

import pytest
from pyspark.sql import functions as F

from packlake import config
from packlake.functions import scalars as sc
from packlake.operators import attrs, checks, compaction, job, namespace, overlay
from packlake.sources import objects, snapshots


def test_next_fit_rotates():
    assert list(compaction.next_fit([15, 15], 20)) == [(0, 0), (1, 0)]
    assert list(compaction.next_fit([10, 5], 10)) == [(0, 0), (1, 0)]
    assert list(compaction.next_fit([5, 40, 5], 10)) == [(0, 0), (1, 0), (2, 0)]


def test_oversize_writes_are_rejected(spark):
    w = spark.createDataFrame([(0, 2, 1, 11), (0, 2, 2, 5)], "lot long, ino long, seq long, len long")
    got = {r["seq"]: (r["chunk_id"], r["chunk_offset"], r["rejected"]) for r in compaction.placements(w, 5).collect()}
    assert got == {1: (None, None, True), 2: ("chunk-00000001", 0, False)}


def test_lots_number_their_chunks_one_after_another(spark):
    w = spark.createDataFrame([(k // 3, k, 1, 7) for k in range(9)], "lot long, ino long, seq long, len long")
    got = [(r["chunk_id"], r["chunk_offset"]) for r in compaction.placements(w, 15, first_seq=99_999_998).orderBy("ino").collect()]
    assert got == [(f"chunk-{99_999_998 + k:08d}", o) for k, o in ((0, 0), (0, 7), (1, 0), (2, 0), (2, 7), (3, 0), (4, 0), (4, 7), (5, 0))]
    chunks = spark.createDataFrame([("chunk-99999999", 1), ("chunk-100000000", 2), ("compacted-1-2", 3), ("index.cbor", 4)], "chunk_id string, size long")
    assert {r["chunk_id"]: r["status"] for r in compaction.with_status(chunks).collect()}["chunk-100000000"] == "Active"
    assert sorted(r["chunk_id"] for r in compaction.sealed(chunks).collect()) == ["chunk-99999999", "compacted-1-2"]


@pytest.mark.parametrize(
    "ids, want",
    [(["chunk-00000003", "chunk-00000001", "chunk-00000007", "chunk-00000002"], 8), (["index.json", "compacted-9-1", "chunk-00000003"], 4), (["x"], 1)],
)
def test_next_sequence(spark, ids, want):
    df = spark.createDataFrame([(x,) for x in ids], "chunk_id string")
    assert compaction.next_chunk_seq(df).first()[0] == want


def test_chunk_ids_round_trip(spark):
    df = spark.createDataFrame([(1,), (123456789012,)], "n long").withColumn("id", sc.chunk_id("n"))
    assert [r[0] for r in df.select(sc.chunk_seq("id")).collect()] == [1, 123456789012]


def test_compaction_into_several_outputs(spark):
    ext = spark.createDataFrame(
        [(k, f"chunk-0000000{k}", 24, 40, 0) for k in (1, 2, 3)], "ino long, chunk_id string, chunk_offset long, length long, file_offset long"
    )
    chunks = spark.createDataFrame([(f"chunk-0000000{k}", 64) for k in (1, 2, 3, 4)] + [("chunk-00000005", 0)], "chunk_id string, size long")
    usage = compaction.chunk_usage(chunks, ext)
    chosen = compaction.targets(usage, 24 / 64)  # equality selects
    assert sorted(r[0] for r in chosen.select("chunk_id").collect()) == [f"chunk-0000000{k}" for k in (1, 2, 3, 4, 5)]
    moved = compaction.pack(ext, chosen, 64, stamp=9)
    out = compaction.compacted_chunks(moved)
    assert [r["size"] for r in out.collect()] == [40, 40, 40]
    after = compaction.remap(ext, moved)
    assert compaction.not_preserved(ext, after).isEmpty()
    assert checks.orphans_in_output(after, out).isEmpty()
    assert compaction.retire(chunks, chosen).isEmpty()


def test_fully_live_chunk_is_left(spark):
    ext = spark.createDataFrame([(2, "c", 0, 50, 0)], "ino long, chunk_id string, chunk_offset long, length long, file_offset long")
    chunks = spark.createDataFrame([("c", 50), ("dead", 50)], "chunk_id string, size long")
    assert [r[0] for r in compaction.targets(compaction.chunk_usage(chunks, ext)).select("chunk_id").collect()] == ["dead"]


ENTRY = "parent_ino long, name string, child_ino long"
LOG = "seq long, op string, ino long, parent_ino long, name string, dst_parent long, dst_name string"


def test_rename_over_existing_and_onto_itself(spark):
    entries = spark.createDataFrame([(1, "src", 2), (1, "dst", 3), (1, "same", 4)], ENTRY)
    log = spark.createDataFrame([(1, "rename", 2, 1, "src", 1, "dst"), (2, "rename", 4, 1, "same", 1, "same")], LOG)
    after = attrs.fold_entries(entries, log)
    assert sorted((r["name"], r["child_ino"]) for r in after.collect()) == [("dst", 2), ("same", 4)]
    inodes = spark.createDataFrame([(1, 0o040000), (2, 0o100000), (3, 0o100000), (4, 0o100000)], "ino long, file_type int")
    assert sorted(r["ino"] for r in attrs.surviving(inodes, after).collect()) == [1, 2, 4]


def test_hard_link_counts(spark):
    inodes = spark.createDataFrame([(1, 0o040000), (2, 0o100000)], "ino long, file_type int")
    entries = spark.createDataFrame([(1, "a", 2), (1, "b", 2)], ENTRY)
    assert dict((r[0], r[1]) for r in namespace.nlinks(entries, inodes).collect()) == {1: 1, 2: 2}
    log = spark.createDataFrame([(1, "unlink", 2, 1, "a", None, None)], LOG)
    assert dict((r[0], r[1]) for r in namespace.nlinks(attrs.fold_entries(entries, log), inodes).collect())[2] == 1


def test_rejected_operations(spark):
    inodes = spark.createDataFrame([(1, 0o040000), (2, 0o040000), (3, 0o100000)], "ino long, file_type int")
    entries = spark.createDataFrame([(1, "d", 2), (2, "f", 3)], ENTRY)
    log = spark.createDataFrame(
        [(1, "rmdir", None, 1, "d", None, None), (2, "create", 9, 3, "x", None, None), (3, "create", 9, 2, "f", None, None),
         (4, "unlink", None, 1, "d", None, None), (5, "unlink", None, 2, "f", None, None), (6, "unlink", None, 2, "q", None, None),
         (7, "rename", 2, 1, "d", 2, "in"), (8, "link", 2, 7, "l", None, None)], LOG,
    )
    got = {r["seq"]: r["reason"] for r in attrs.rejected_operations(entries, inodes, log).collect()}
    assert got == {
        1: "not empty", 2: "parent is not a directory", 3: "exists", 4: "is a directory", 6: "no entry", 7: "into itself", 8: "no parent",
    }


def test_latest_attrs_keep_earlier_fields(spark):
    log = spark.createDataFrame([(2, 1, 10, 0o600, None), (2, 2, 20, None, 5), (2, 3, 30, 0o644, None)], "ino long, seq long, ts_ns long, mode int, size long")
    r = attrs.latest_attrs(log).first()
    assert (r["mode"], r["size"], r["ctime_ns"]) == (0o644, 5, 30)
    inodes = spark.createDataFrame([(2, 0o111, 600, 2, 1, 1)], "ino long, mode int, size long, blocks long, mtime_ns long, ctime_ns long")
    assert tuple(attrs.apply_attrs(inodes, log).first()) == (2, 0o644, 5, 1, 20, 30)


def test_setattr_times(spark):
    inodes = spark.createDataFrame([(k, 600, 1, 1) for k in (2, 3, 4, 5)], "ino long, size long, mtime_ns long, ctime_ns long")
    log = spark.createDataFrame(
        [(2, 1, 77, 5, None), (3, 1, 77, 600, None), (4, 1, 77, 600, 9), (4, 2, 78, 5, 10), (4, 3, 79, None, 11), (5, 1, 77, 5, None), (5, 2, 78, 5, None)],
        "ino long, seq long, ts_ns long, size long, mtime_ns long",
    )
    got = {r["ino"]: (r["size"], r["mtime_ns"], r["ctime_ns"]) for r in attrs.apply_attrs(inodes, log).collect()}
    assert got == {2: (5, 77, 77), 3: (600, 1, 77), 4: (5, 11, 79), 5: (5, 77, 78)}
    ext = spark.createDataFrame([(2, 0, 3), (2, 4, 10), (3, 0, 600)], "ino long, file_offset long, length long")
    assert sorted((r["ino"], r["file_offset"], r["length"]) for r in attrs.trimmed(ext, log).collect()) == [(2, 0, 3), (2, 4, 1), (3, 0, 600)]


def test_capacity(spark):
    schema = "at long, ino long, op string, off long, len long"
    small = [(1, 2, "write", 0, 100), (2, 2, "write", 0, 100), (3, 2, "write", 100, 1)]  # fits, overwrites, is refused
    assert [tuple(r) for r in overlay.capacity_rejections(spark.createDataFrame(small, schema), 100).collect()] == [(3, 2, 1)]
    files = [(1, 2, "write", 0, 100), (2, 2, "truncate", 0, 0), (3, 2, "write", 0, 60), (4, 3, "write", 0, 60)]
    assert [tuple(r) for r in overlay.capacity_rejections(spark.createDataFrame(files, schema), 110).collect()] == [(4, 3, 60)]
    r = random.Random(4)
    for capacity in (150, 400, 5000):
        log, size, want = [], {}, []
        for at in range(300):
            ino, op, off, n = r.randrange(8), r.choice(["write"] * 4 + ["truncate"]), r.randrange(60), r.randrange(40)
            log.append((at, ino, op, off, n))
            now = size.get(ino, 0)
            new = off if op == "truncate" else max(now, off + n if n else 0)
            if op == "write" and sum(size.values()) + new - now > capacity and new > now:
                want.append((at, ino, new - now))
            else:
                size[ino] = new
        got = overlay.capacity_rejections(spark.createDataFrame(log, schema), capacity, lot_ops=32).collect()
        assert [tuple(x) for x in got] == want


def test_renames_onto_the_same_inode(spark):
    entries = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (1, "c", 2), (1, "d", 3)], ENTRY)
    rows = [(1, "rename", 2, 1, "a", 1, "b"), (2, "rename", 2, 1, "c", 1, "a"), (3, "rename", 3, 1, "d", 1, "c"), (4, "rename", 2, 1, "b", 1, "e")]
    after = attrs.fold_entries(entries, spark.createDataFrame(rows, LOG))
    assert sorted((r["name"], r["child_ino"]) for r in after.collect()) == [("a", 2), ("c", 3), ("e", 2)]


def test_entry_times_and_missing_xattrs(spark):
    log = spark.createDataFrame([(1, "link", 2, 1, "a", None, None, 10), (2, "rename", 2, 1, "a", 5, "b", 20)], LOG + ", ts_ns long")
    inodes = spark.createDataFrame([(k, 0, 0) for k in (1, 2, 5, 9)], "ino long, mtime_ns long, ctime_ns long")
    got = {r["ino"]: (r["mtime_ns"], r["ctime_ns"]) for r in attrs.apply_entry_times(inodes, log).collect()}
    assert got == {1: (20, 20), 2: (0, 20), 5: (20, 20), 9: (0, 0)}
    x = spark.createDataFrame([(2, "a", "1")], "ino long, name string, value string")
    log = spark.createDataFrame([(1, 2, "a", None), (2, 2, "a", None), (3, 2, "b", "x"), (4, 2, "b", None), (5, 3, "a", None)], "seq long, ino long, name string, value string")
    assert sorted(r["seq"] for r in attrs.xattr_rejections(x, log).collect()) == [2, 5]


def test_errors_of_listings_and_links(spark):
    inodes = spark.createDataFrame([(1, 0o040000), (2, 0o100000), (3, 0o120000)], "ino long, file_type int")
    asked = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "ino long")
    assert {r["ino"]: r["error"] for r in namespace.readdir_errors(asked, inodes).collect()} == {2: "ENOTDIR", 3: "ENOTDIR", 4: "ENOENT"}
    links = spark.createDataFrame([(3, "/t")], "ino long, target string")
    got = {r["ino"]: (r["target"], r["error"]) for r in namespace.readlinks(asked, inodes, links).collect()}
    assert got == {1: (None, "EINVAL"), 2: (None, "EINVAL"), 3: ("/t", None), 4: (None, "ENOENT")}


def _file_system(spark, root):
    """Three chunks of 64 bytes, 40 of them live, a full one and an active one; a version that names them."""
    store = objects.Store(spark, root + "/objects")
    rows, want = [], {}
    for k in (1, 2, 3, 4, 100_000_000):
        data = bytes((k * 31 + j) % 251 for j in range(64))
        store.put(f"chunk-{k:08d}", data)
        live = 64 if k in (4, 100_000_000) else 40
        rows.append((k + 10, f"chunk-{k:08d}", 64 - live, live, 0))
        want[k + 10] = data[64 - live :]
    tables = snapshots.new_tables(spark)
    files = [(i, 0o100000, 0o644, 1, 0, 0, len(d), 0, 0, 0, 4096, 1, 0) for i, d in want.items()]
    tables["inodes"] = tables["inodes"].union(spark.createDataFrame(files, tables["inodes"].schema))
    tables["extents"] = spark.createDataFrame(rows, tables["extents"].schema)
    snapshots.save(spark, root + "/state", tables)
    asked = spark.createDataFrame([(i, i, 0, 1000) for i in want], "request_id long, ino long, off long, len long")
    return store, want, lambda: {r["request_id"]: bytes(r["data"]) for r in job.read(store, root + "/state", asked).collect()}


def test_compaction_job(spark, tmp_path):
    root = str(tmp_path)
    store, want, read = _file_system(spark, root)
    assert read() == want
    assert job.compact(store, root + "/state", limit=64, stamp=7, threshold=24 / 64) == 2
    assert read() == want
    names = sorted(r["chunk_id"] for r in store.list().collect())
    assert [n for n in names if n.startswith("chunk")] == ["chunk-00000004", "chunk-100000000"]
    assert sorted(store.size(n) for n in names if n.startswith("compacted")) == [40, 40, 40]
    assert job.compact(store, root + "/state", limit=64, stamp=8, threshold=24 / 64) is None


@pytest.mark.parametrize("where", ["put", "save", "delete"])
def test_compaction_survives_a_crash_between_steps(spark, tmp_path, monkeypatch, where):
    root = str(tmp_path)
    store, want, read = _file_system(spark, root)

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if where == "put":
            m.setattr(objects.Store, "put_all", lost)
        elif where == "save":
            m.setattr(snapshots, "publish", lost)
        else:
            m.setattr(objects.Store, "delete_all", lost)
        with pytest.raises(KeyboardInterrupt):
            job.compact(store, root + "/state", limit=64, stamp=7, threshold=24 / 64)
    assert read() == want
    assert snapshots.current_version(spark, root + "/state") == (2 if where == "delete" else 1)
    job.compact(store, root + "/state", limit=64, stamp=8, threshold=24 / 64)
    assert read() == want
    left = {r["chunk_id"] for r in store.list().collect()}
    assert {f"chunk-0000000{k}" for k in (1, 2, 3)}.isdisjoint(left)


def test_a_lost_pointer_is_found_again_and_nothing_is_written_over(spark, tmp_path):
    root = str(tmp_path / "s")
    snapshots.save(spark, root, snapshots.new_tables(spark))
    touched = snapshots.load(spark, root)["inodes"].withColumn("atime_ns", F.lit(9).cast("long"))
    snapshots.save(spark, root, {"inodes": touched})
    os.remove(f"{root}/CURRENT")
    assert snapshots.current_version(spark, root) == 2
    os.makedirs(f"{root}/v=3")  # begun, never completed
    assert snapshots.current_version(spark, root) == 2
    assert snapshots.save(spark, root, {"inodes": touched}) == 4
    assert snapshots.load(spark, root)["inodes"].first()["atime_ns"] == 9


def test_flush_keeps_the_active_chunk(spark, tmp_path):
    store = objects.Store(spark, str(tmp_path / "o"))
    w = [("chunk-00000001", 0, b"old"), ("chunk-00000002", 3, b"def"), ("chunk-00000002", 0, b"abc")]
    writes = spark.createDataFrame(w, "chunk_id string, chunk_offset long, data binary")
    for version in (1, 2):
        assert job.flush(store, str(tmp_path / "s"), writes, snapshots.new_tables(spark)) == version
    assert [tuple(r) for r in store.list().collect()] == [("chunk-00000002", 6)]
    assert store.get("chunk-00000002", 1, 4) == b"bcde"
    with pytest.raises(FileNotFoundError):
        store.size("chunk-00000001")
    with pytest.raises(OSError, match="short read"):
        store.get("chunk-00000002", 4, 4)


def test_store_of_settings(spark, tmp_path):
    c = config.load({"PACKLAKE_LOCATION": str(tmp_path), "PACKLAKE_PREFIX": "tenant", "PACKLAKE_REGION": "x-1"})
    store = objects.Store.from_config(spark, c)
    store.put("chunk-00000001", b"abc")
    assert (tmp_path / "tenant" / "chunk-00000001").read_bytes() == b"abc"
    assert spark.sparkContext._jsc.hadoopConfiguration().get("fs.s3a.endpoint.region") == "x-1"


def test_checks_find_violations(spark):
    inodes = spark.createDataFrame([(1, 0o040000, 5, -1), (2, 0o100000, 1, 4)], "ino long, file_type int, nlink long, size long")
    entries = spark.createDataFrame([(1, "a", 2), (1, "a", 2), (2, "b", 7)], ENTRY)
    assert checks.duplicate_names(entries).count() == 1
    assert checks.dangling_entries(entries, inodes).count() == 1
    assert checks.parent_not_directory(entries, inodes).count() == 1
    assert checks.wrong_nlink(entries, inodes).count() == 2
    assert checks.negative_size(inodes).count() == 1
    ext = spark.createDataFrame([(2, "c", 0, 5, 0), (2, "c", 5, 5, 3)], "ino long, chunk_id string, chunk_offset long, length long, file_offset long")
    assert checks.overlapping_extents(ext).count() == 1
    assert checks.extents_beyond_size(ext, inodes.select("ino", "size")).count() == 1
    chunks = spark.createDataFrame([("c", "Sealed", 8)], "chunk_id string, status string, size long")
    assert checks.extent_out_of_chunk(ext, chunks).count() == 1
    assert checks.chunk_state(chunks, 10, 5).count() == 1
    assert checks.next_seq_bound(chunks, 1).count() == 1 and checks.next_seq_bound(chunks, 2).isEmpty()
    assert checks.root_is_directory(inodes.where("ino = 2")).count() == 1
    assert checks.ino_not_below_next(inodes, 2).count() == 1
    assert checks.unsealed_targets(chunks, chunks.withColumn("status", F.lit("Active"))).count() == 1
    assert checks.target_of_other_type(spark.createDataFrame([(2, "t")], "ino long, target string"), inodes).count() == 1
    assert checks.xattr_without_inode(spark.createDataFrame([(2, "n"), (7, "n")], "ino long, name string"), inodes).count() == 1
    assert checks.odd_block_size(inodes.withColumn("blksize", F.lit(512)), 4096).count() == 2
    assert checks.over_capacity(inodes, 3).count() == 1 and checks.over_capacity(inodes, 4).isEmpty()
    assert checks.reserved_listed(spark.createDataFrame([("index.cbor",), ("c",)], "chunk_id string")).count() == 1
    assert checks.orphans_in_output(ext, spark.createDataFrame([("c", 11)], "chunk_id string, size long")).count() == 1
    old = inodes.withColumn("atime_ns", F.lit(1))
    assert checks.versions_differ(old, old.withColumn("atime_ns", F.lit(2)), ("atime_ns",)).isEmpty()
    assert checks.versions_differ(old, old.withColumn("atime_ns", F.lit(2))).count() == 4
    assert checks.next_ino_rolled_back(inodes, inodes.where("ino = 1")).count() == 1 and checks.next_ino_rolled_back(inodes, inodes).isEmpty()


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert snapshots.current_version(spark, root) is None
    tables = snapshots.load_or_empty(spark, root)
    assert tables["inodes"].count() == 1
    assert snapshots.save(spark, root, tables) == 1
    first = snapshots.load(spark, root)
    touched = first["inodes"].withColumn("atime_ns", F.lit(9).cast("long"))
    assert snapshots.is_dirty(first["inodes"], touched)
    assert not snapshots.is_structurally_dirty(first["inodes"], touched)
    assert snapshots.save(spark, root, {"inodes": touched}) == 2
    assert snapshots.load(spark, root)["inodes"].first()["atime_ns"] == 9
    with pytest.raises(ValueError):
        snapshots.drop_version(spark, root, 2)
    snapshots.drop_version(spark, root, 1)
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, str(tmp_path / "none"))


def test_objects(spark, tmp_path):
    root = str(tmp_path / "objects")
    data = bytes(range(200))
    for name in ("chunk-00000001", "chunk-00000002", "index.cbor"):
        objects.put(root, name, data)
    assert sorted(tuple(r) for r in objects.listing(spark, root).collect()) == [("chunk-00000001", 200), ("chunk-00000002", 200)]
    ranges = [(0, 1), (0, 200), (10, 50), (199, 1), (100, 100)]
    req = spark.createDataFrame([("chunk-00000001", o, n) for o, n in ranges], "chunk_id string, off long, len long")
    got = {(r["off"], r["len"]): bytes(r["data"]) for r in objects.read_ranges(req, root).collect()}
    assert got == {(o, n): data[o : o + n] for o, n in ranges}
    short = spark.createDataFrame([("chunk-00000001", 150, 100)], "chunk_id string, off long, len long")
    with pytest.raises(Exception, match="short read"):
        objects.read_ranges(short, root).collect()
    spark.dataSource.register(objects.ChunkRanges)
    df = spark.read.format("chunk_ranges").option("root", root).option("ranges", "chunk-00000002:5:3,chunk-00000001:0:2").load()
    assert sorted((r["chunk_id"], bytes(r["data"])) for r in df.collect()) == [("chunk-00000001", data[:2]), ("chunk-00000002", data[5:8])]
    objects.delete(spark, root, ["chunk-00000001", "missing"])
    assert objects.listing(spark, root).count() == 1
    with pytest.raises(ValueError):
        objects.put(root, "../x", b"")


def test_config():
    c = config.load({})
    assert (c.max_chunk_bytes, c.block_bytes, c.max_fs_bytes, c.compaction_threshold) == (64 << 20, 4096, 1 << 40, 0.3)
    assert c.trigger == "30000 milliseconds"
    assert config.load({"PACKLAKE_PERSIST_INTERVAL": "1m30s", "PACKLAKE_PREFIX": "t1"}).root.endswith("/t1")
    for bad in ({"PACKLAKE_MAX_FS_BYTES": "x"}, {"PACKLAKE_MAX_FS_BYTES": "0"}, {"PACKLAKE_COMPACTION_THRESHOLD": "2"}, {"PACKLAKE_PERSIST_INTERVAL": "soon"}):
        with pytest.raises(ValueError):
            config.load(bad)


def test_paths_of_a_cycle_free_tree(spark):
    entries = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (2, "c", 4), (1, "hard", 4)], ENTRY)
    got = sorted((r["ino"], r["path"], r["depth"]) for r in namespace.paths(entries).collect())
    assert got == [(1, "/", 0), (2, "/a", 1), (3, "/a/b", 2), (4, "/a/c", 2), (4, "/hard", 1)]


def test_paths_of_over_a_million_entries(spark):
    n = 1_200_000
    entries = spark.range(n).selectExpr("case when id < 100 then 1 else id % 100 + 2 end as parent_ino", "concat('f', id) as name", "id + 2 as child_ino")
    got = namespace.paths(entries)
    assert got.groupBy("depth").count().orderBy("depth").collect() == [(0, 1), (1, 100), (2, n - 100)]
    assert got.where("ino = 1000002").first()["path"] == "/f0/f1000000"


def test_paths_of_a_cycle_are_an_error(spark):
    entries = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, "c", 2)], ENTRY)
    with pytest.raises(RuntimeError):
        namespace.paths(entries, max_depth=4)
