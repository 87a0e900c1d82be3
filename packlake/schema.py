"""Explicit schemas of the storage model's tables."""

from pyspark.sql import types as T


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in columns.items()])


_L, _I, _S, _B = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()

INODES = _struct(
    ino=_L, file_type=_I, mode=_I, nlink=_L, uid=_L, gid=_L, size=_L,
    atime_ns=_L, mtime_ns=_L, ctime_ns=_L, blksize=_I, blocks=_L, rdev=_L,
)
DIR_ENTRIES = _struct(parent_ino=_L, name=_S, child_ino=_L)
EXTENTS = _struct(ino=_L, chunk_id=_S, chunk_offset=_L, length=_L, file_offset=_L)
SYMLINKS = _struct(ino=_L, target=_S)
XATTRS = _struct(ino=_L, name=_S, value=_B)
CHUNKS = _struct(chunk_id=_S, status=_S, size=_L)
OP_LOG = _struct(
    seq=_L, ts_ns=_L, op=_S, ino=_L, parent_ino=_L, name=_S, dst_parent=_L, dst_name=_S, offset=_L, length=_L,
    mode=_I, uid=_L, gid=_L, size=_L, chunk_id=_S, chunk_offset=_L, xattr_name=_S, xattr_value=_B,
)
TABLES = {
    "inodes": INODES,
    "dir_entries": DIR_ENTRIES,
    "extents": EXTENTS,
    "symlinks": SYMLINKS,
    "xattrs": XATTRS,
    "chunks": CHUNKS,
}

# fixed values: POSIX file type bits
S_IFREG, S_IFDIR, S_IFLNK = 0o100000, 0o040000, 0o120000
ROOT_INO = 1
BLOCK_SIZE = 4096
