"""Chunk objects: listing, whole and ranged reads, writes and deletes.

Listings use Spark's binaryFile source, project path and length only and open no object.
Whole reads use it too. Ranged reads, writes and deletes run in tasks on Arrow's file
systems, which reach local and mounted paths, HDFS and S3, and move only the bytes wanted.
`Store` puts these under one interface for a root."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Config
from ..functions.scalars import is_object_id

INDEX_KEY = "index.cbor"
_ID = re.compile(r"[A-Za-z0-9._-]+")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """chunk_id, size of the objects at a root, without the index."""
    return (
        spark.read.format("binaryFile").load(root)
        .select(F.element_at(F.split("path", "/"), -1).alias("chunk_id"), F.coalesce("length", F.lit(0)).alias("size"))
        .where((F.col("chunk_id") != INDEX_KEY) & is_object_id("chunk_id"))
    )


def contents(spark: SparkSession, root: str) -> DataFrame:
    """chunk_id, content of whole objects."""
    return spark.read.format("binaryFile").load(root).select(F.element_at(F.split("path", "/"), -1).alias("chunk_id"), "content")


def _checked(chunk_id: str) -> str:
    if not _ID.fullmatch(chunk_id):
        raise ValueError(f"bad object id: {chunk_id!r}")
    return chunk_id


def filesystem(root: str, options: dict[str, str] | None = None) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a root, and the path in it. options: endpoint, region of S3."""
    scheme, _, rest = root.partition("://")
    if scheme in ("s3", "s3a", "s3n") and rest:
        given = {k: v for k, v in (options or {}).items() if v}
        endpoint = given.get("endpoint")
        how = {"region": given.get("region"), "endpoint_override": endpoint and endpoint.partition("://")[2] or endpoint}
        if endpoint and endpoint.startswith("http://"):
            how["scheme"] = "http"
        return pafs.S3FileSystem(**{k: v for k, v in how.items() if v}), rest
    if not rest:
        return pafs.LocalFileSystem(), root.removeprefix("file:")
    return pafs.FileSystem.from_uri(root)


def read_range(store: pafs.FileSystem, path: str, chunk_id: str, off: int, length: int) -> bytes:
    """Bytes of an object; a missing object or a short read is an error."""
    with store.open_input_file(f"{path}/{_checked(chunk_id)}") as f:
        data = f.read_at(length, off)
    if len(data) != length:
        raise OSError(f"short read of {chunk_id}")
    return data


def read_ranges(requests: DataFrame, root: str, options: dict[str, str] | None = None, keep: int = 8) -> DataFrame:
    """requests (chunk_id, off, len and any other columns) with data. Requests are grouped by
    chunk and ordered by place; a task holds up to `keep` open objects' last ranges, so that
    equal requests after each other are read once. Only the wanted bytes leave the store."""
    names = [*requests.columns, "data"]
    at = [requests.columns.index(c) for c in ("chunk_id", "off", "len")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(root, options)
        held: dict[tuple, bytes] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data = []
                for key in zip(*(part.column(k).to_pylist() for k in at), strict=True):
                    if key not in held:
                        if len(held) >= keep:
                            held.clear()
                        held[key] = read_range(store, path, *key)
                    data.append(held[key])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", data binary"
    return requests.repartition("chunk_id").sortWithinPartitions("chunk_id", "off", "len").mapInArrow(run, schema)


def put(root: str, chunk_id: str, data: bytes, options: dict[str, str] | None = None) -> None:
    """Write an object whole: aside, then moved into place, where the store has folders; a store
    of objects shows a new one only when it is complete."""
    store, path = filesystem(root, options)
    whole = f"{path}/{_checked(chunk_id)}"
    if isinstance(store, pafs.S3FileSystem):
        with store.open_output_stream(whole) as f:
            f.write(data)
        return
    store.create_dir(path, recursive=True)
    aside = f"{path}/.put-{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as f:
        f.write(data)
    store.move(aside, whole)


def put_all(rows: DataFrame, root: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write the objects of rows (chunk_id, data) in tasks; chunk_id, size of what was written.
    Nothing is written until the result is used; writing again gives the same objects."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = batch.column(0).to_pylist(), []
            for k, chunk_id in enumerate(ids):
                data = batch.column(1)[k].as_py()
                put(root, chunk_id, data, options)
                size.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(size, pa.int64())], ["chunk_id", "size"])

    return rows.select("chunk_id", "data").mapInArrow(run, "chunk_id string, size long")


def delete(spark: SparkSession, root: str, ids: list[str]) -> None:
    """Remove objects; a missing one is fine."""
    jvm = spark.sparkContext._jvm
    for chunk_id in ids:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{_checked(chunk_id)}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)


def delete_all(rows: DataFrame, root: str, options: dict[str, str] | None = None) -> int:
    """Remove the objects that rows (chunk_id) name, in tasks; how many there were."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(root, options)
        for batch in batches:
            gone = []
            for chunk_id in batch.column(0).to_pylist():
                whole = f"{path}/{_checked(chunk_id)}"
                if store.get_file_info(whole).type != pafs.FileType.NotFound:
                    store.delete_file(whole)
                    gone.append(chunk_id)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.string())], ["chunk_id"])

    return rows.select("chunk_id").distinct().mapInArrow(run, "chunk_id string").count()


class Store:
    """The objects at a root: put, ranged read, delete, list, size."""

    def __init__(self, spark: SparkSession, root: str, options: dict[str, str] | None = None):
        self.spark, self.root, self.options = spark, root, options or {}

    @classmethod
    def from_config(cls, spark: SparkSession, config: Config) -> Store:
        """The store that settings name; S3 settings are applied to the session."""
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for key, value in config.hadoop_options().items():
            hadoop.set(key.removeprefix("spark.hadoop."), value)
        return cls(spark, config.root, {"endpoint": config.endpoint, "region": config.region})

    def list(self) -> DataFrame:
        return listing(self.spark, self.root)

    def size(self, chunk_id: str) -> int:
        info = self._info(chunk_id)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(chunk_id)
        return info.size

    def _info(self, chunk_id: str):
        store, path = filesystem(self.root, self.options)
        return store.get_file_info(f"{path}/{_checked(chunk_id)}")

    def put(self, chunk_id: str, data: bytes) -> None:
        put(self.root, chunk_id, data, self.options)

    def put_all(self, rows: DataFrame) -> DataFrame:
        return put_all(rows, self.root, self.options)

    def get(self, chunk_id: str, off: int, length: int) -> bytes:
        return read_range(*filesystem(self.root, self.options), chunk_id, off, length)

    def ranges(self, requests: DataFrame) -> DataFrame:
        return read_ranges(requests, self.root, self.options)

    def delete(self, ids: list[str]) -> None:
        delete(self.spark, self.root, ids)

    def delete_all(self, rows: DataFrame) -> int:
        return delete_all(rows, self.root, self.options)


class _Range(InputPartition):
    def __init__(self, chunk_id: str, off: int, length: int):
        self.chunk_id, self.off, self.length = chunk_id, off, length


class ChunkRanges(DataSource):
    """spark.read.format("chunk_ranges").option("root", ...).option("ranges", "id:off:len,...")"""

    @classmethod
    def name(cls) -> str:
        return "chunk_ranges"

    def schema(self) -> str:
        return "chunk_id string, off long, len long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.ranges = [x.rsplit(":", 2) for x in options.get("ranges", "").split(",") if x]

    def partitions(self) -> list[InputPartition]:
        return [_Range(c, int(o), int(n)) for c, o, n in self.ranges]

    def read(self, partition: _Range) -> Iterator[tuple]:
        data = read_range(*filesystem(self.root), partition.chunk_id, partition.off, partition.length)
        yield partition.chunk_id, partition.off, partition.length, data
