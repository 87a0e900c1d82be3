"""Packing: space-filling-curve order.

Each document becomes a hashed bag-of-words vector, projected to a few dimensions by
fixed random signs; the cell of its point on a Hilbert curve is its sort key. Documents
are range-sorted by that key and laid end to end along the curve, so neighbours in a
sequence resemble each other, and the stream is cut every `seq_len` ids: only the last
sequence of all has padding.

In the pipeline, documents come in the order of a mixture (`in_files`). Then the curve is
walked within windows of `window_docs` documents of that order, and the windows follow each
other: every stretch of sequences has the mixture's shares, and neighbours within a
sequence still resemble each other.

Two narrow facts are global: cut points of the key (a bounded list that balances the
ranges, ties broken by a hash of the id so that copies do not share a range) and the
number of ids in each range, whose running sum tells each range where it starts.

Defined cases: a null or empty text has the closing id alone; a null doc_id is an id like
any other; repeated rows are packed as often as they occur; an empty table gives no pieces;
documents that do not come straight from files have no order, and are one window; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import range_part, slices, table, tidied, weighted_bounds, written

DIMS, BITS = 4, 8
#: Bits of the sort key: the window, the position on the curve and a hash of the id.
KEY_BITS = 62
#: Files whose places are broadcast; of more, they are joined.
FILES = 200_000
#: Documents of a window: eight blocks of the mixture.
WINDOW_DOCS = 512
EOS = 2
#: Pieces whose ids a worker remembers.
CACHE_WORDS = 800_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows), each 0 .. 2**bits - 1.

    The Gray-code walk of Skilling (2004): undo the rotations from the coarsest bit
    down, then interleave the bits of the axes."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


#: White space to Python, which need not be white space to a tokenizer.
_ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def split_words(text: str) -> list[str]:
    """Runs of characters other than ASCII white space."""
    odd = _ODD_SPACE[:4] if text.isascii() else _ODD_SPACE
    if any(c in text for c in odd):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


# fixed value: the pattern by which the tokenizer cuts a text before merging
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters need no normalization but lower case.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f]+")
#: Signs that often end a word; each is a piece of its own.
_SIGNS = ".,!?;:|"
#: Most words: letters that need nothing but lower case, with one of the signs or none.
_REGULAR = f"^[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+[{_SIGNS}]?$"


class Memory:
    """Bytes by word, in two generations of up to half of `size` words each: a full one
    becomes the old one, and what is still in use moves on from there."""

    def __init__(self, size: int = CACHE_WORDS):
        self.size = size // 2
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, words: list[str], learn) -> list[bytes]:
        """The bytes of distinct words; learn: those of a list of words that are not known."""
        found = list(map(self.now.get, words))
        if None in found:
            new = [w for w, v in zip(words, found, strict=True) if v is None]
            if len(self.now) + len(new) > self.size:
                self.now, self.old = dict(x for x in zip(words, found, strict=True) if x[1] is not None), self.now
            self.now.update((w, self.old[w]) for w in new if w in self.old)
            new = [w for w in new if w not in self.old]
            self.now.update(zip(new, learn(new), strict=True))
            found = list(map(self.now.__getitem__, words))
        return found


def _joined(values: list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a list of byte strings, end to end, and how many each has."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(values), dtype), sizes


def _gathered(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the members of groups lie that are stored end to end, for the groups `at` in turn."""
    taken = sizes[at]
    return np.arange(taken.sum()) + np.repeat((np.cumsum(sizes) - sizes)[at] - (np.cumsum(taken) - taken), taken)


class Encoder:
    """Ids of texts, word by word where the tokenizer allows it: if it drops white space and
    never joins across it, the ids of a text are those of its words in order, and those of a
    plain word are those of its lower-cased pieces. Each distinct word of many documents is
    looked up once, in a memory of bounded size, and new ones are encoded in one call."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65_536 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        self.width = array(self.code).itemsize
        self.pieces, self.words = Memory(), Memory(CACHE_WORDS // 4)
        self.cut = regex.compile(_PIECES).findall
        self.plain = None
        how = json.loads(self.tokenizer.to_str())
        norm, pre = how["normalizer"] or {}, how["pre_tokenizer"] or {}
        steps = [x["type"] for x in norm.get("normalizers", ())], [x["type"] for x in pre.get("pretokenizers", ())]
        if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            split = pre["pretokenizers"][0]
            if split["pattern"] == {"Regex": _PIECES} and split["invert"] and split["behavior"] == "Removed":
                how |= {"normalizer": None, "pre_tokenizer": pre["pretokenizers"][1]}
                self.plain = Tokenizer.from_str(json.dumps(how))
                self.signs, self.sign_size = _joined(self._pieces(list(_SIGNS)), self.dtype)

    def _encoded(self, tokenizer, texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return self._encoded(self.plain, pieces)

    def _uncommon(self, words: list[str]) -> list[bytes]:
        """Words that are more than letters and a sign."""
        plain = [bool(w.isprintable() and "<|" not in w and _PLAIN.fullmatch(w)) for w in words]
        parts = [self.cut(w.lower()) for w, p in zip(words, plain, strict=True) if p]
        wanted = list({x for p in parts for x in p})
        known = dict(zip(wanted, self.pieces.of(wanted, self._pieces), strict=True))
        whole = iter(self._encoded(self.tokenizer, [w for w, p in zip(words, plain, strict=True) if not p]))
        cut = (b"".join(map(known.__getitem__, p)) for p in parts)
        return [next(cut if p else whole) for p in plain]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, end to end, and how many each has."""
        regular = pc.match_substring_regex(words, _REGULAR)
        low = pc.utf8_lower(words.filter(regular))
        stems = pc.utf8_rtrim(low, _SIGNS)
        n_low, n_stem = (pc.binary_length(x).to_numpy() for x in (low, stems))
        last = np.frombuffer(low.buffers()[2] or b"", np.uint8)[: n_low.sum()][np.cumsum(n_low) - 1]
        sign = np.where(n_low > n_stem, np.searchsorted(_SIGN_CODES, last), -1)
        stems = stems.dictionary_encode()
        stem_ids, stem_size = _joined(self.pieces.of(stems.dictionary.to_pylist(), self._pieces), self.dtype)
        other_ids, other_size = _joined(self.words.of(words.filter(pc.invert(regular)).to_pylist(), self._uncommon), self.dtype)
        # parts of words: stems, signs (the last one is none), then words that are not regular
        ids = np.concatenate([stem_ids, self.signs, other_ids])
        size = np.concatenate([stem_size, self.sign_size, [0], other_size])
        part = np.full((len(words), 2), len(stem_size) + len(_SIGNS))
        is_regular = regular.to_numpy(zero_copy_only=False)
        part[is_regular, 0] = stems.indices.to_numpy()
        part[is_regular, 1] = len(stem_size) + np.where(sign < 0, len(_SIGNS), _SIGN_ORDER[sign])
        part[~is_regular, 0] = len(stem_size) + len(_SIGNS) + 1 + np.arange(len(other_size))
        return ids[_gathered(size, part.ravel())], size[part].sum(axis=1)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, end to end, and how many each text has."""
        texts = pc.fill_null(texts, "")
        if self.plain is None:
            return _joined(self._encoded(self.tokenizer, texts.to_pylist()), self.dtype)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, size = self._words(words.dictionary)
        at = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[at])])[np.cumsum(pc.list_value_length(split).to_numpy())]
        return ids[_gathered(size, at)], np.diff(ends, prepend=0)


#: The signs' codes in order, and the place in _SIGNS of each of them.
_SIGN_ORDER = np.argsort([ord(x) for x in _SIGNS])
_SIGN_CODES = np.sort([ord(x) for x in _SIGNS])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def _directions(size: int) -> np.ndarray:
    """A fixed random bit for each dimension and id."""
    return np.random.default_rng(9).integers(0, 2, (size, DIMS)).T.astype(np.int64)


def _places(ids: np.ndarray, counts: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The documents' points: the mean direction of their tokens, scaled so that long texts
    spread about as far as short ones, then squashed to the grid. Without tokens: the middle."""
    begin = np.minimum(np.cumsum(counts) - counts, max(0, len(ids) - 1))
    n = np.maximum(counts, 1)[:, None]
    plus = [np.add.reduceat(d[ids], begin) if len(ids) else np.zeros(len(counts)) for d in directions]
    mean = (2 * np.stack(plus, axis=1) / n - 1) * np.minimum(n, 64) ** 0.5
    mean[counts == 0] = 0
    return np.clip((np.tanh(mean / 2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def in_files(docs: DataFrame) -> DataFrame:
    """docs, as read from files that were written in some order, with `__at`: the place of a row
    in that order. Files are numbered by name; a row per file, some hundred bytes, tells how many
    rows lie before it, and up to FILES of them are broadcast."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = written(files.select("__file", before.alias("__before")), "files")
    files = F.broadcast(files) if files.count() <= FILES else files
    return rows.join(files, "__file").select("doc_id", "text", (F.col("__before") + F.col("__row")).alias("__at"))


def tokenized(docs: DataFrame, tokenizer: str, eos: int = EOS) -> DataFrame:
    """doc_id, curve (Hilbert key), n (ids with the closing one), ids (little-endian bytes), and
    `__at` of docs (0 without)."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        coder = _encoder(tokenizer)
        directions = _directions(coder.tokenizer.get_vocab_size())
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, counts = coder.ids(batch.column(1))
            key = hilbert_key(_places(ids, counts, directions))
            closed = np.full(len(ids) + len(counts), eos, coder.dtype)
            closed[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            ends = np.concatenate([[0], np.cumsum(counts + 1)]) * coder.width
            raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(closed)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(key), pa.array(counts + 1), raw, batch.column(2)], ["doc_id", "curve", "n", "ids", "__at"]
            )

    at = F.col("__at") if "__at" in docs.columns else F.lit(0).cast("long").alias("__at")
    return docs.select("doc_id", "text", at).mapInArrow(tidied(run), "doc_id long, curve long, n long, ids binary, __at long")


def _cut(starts: dict[int, int], seq_len: int, width: int):
    """Cuts the documents of a partition, sorted by range and key, every `seq_len` ids."""

    def run(batches):
        part, at = None, 0
        for batch in batches:
            out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for p, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "ids")), strict=True):
                if p != part:
                    part, at = p, starts[p]
                start = 0
                seq = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                while start < n:
                    offset = (at + start) % seq_len
                    length = min(n - start, seq_len - offset)
                    for c, v in zip(
                        out,
                        (doc, start, length, zlib.crc32(seq[4 * start : 4 * (start + length)]), n, (at + start) // seq_len, offset),
                        strict=True,
                    ):
                        out[c].append(v)
                    start += length
                at += n
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def packed(
    docs: DataFrame,
    tokenizer: str | None = None,
    seq_len: int = 4096,
    eos: int = EOS,
    range_tokens: int = 1_000_000,
    window_docs: int = WINDOW_DOCS,
) -> DataFrame:
    """One row per piece (see PIECES). range_tokens: ids that one range of the curve has
    about; it sets the parallelism, not the result's quality. docs may have `__at`, a place in
    an order that windows of window_docs documents keep."""
    tokens = written(tokenized(docs, tokenizer or default_tokenizer(), eos), "tokens")
    total, last = tokens.agg(F.sum("n"), F.max("__at")).first()
    if not total:
        return docs.sparkSession.createDataFrame([], PIECES)
    # windows first, then the curve's DIMS * BITS bits as far as there is room; a hash of the id parts ties
    room = KEY_BITS - (last // window_docs).bit_length()
    curve = min(room, DIMS * BITS)
    keyed = tokens.withColumn(
        "key",
        F.shiftleft(F.floor(F.col("__at") / window_docs), room)
        + F.shiftleft(F.shiftright("curve", DIMS * BITS - curve), room - curve)
        + F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - room + curve if room > curve else 63) * F.lit(int(room > curve)),
    )
    bounds = weighted_bounds(keyed, "key", "n", max(range_tokens, total // 20_000), KEY_BITS)
    keyed = keyed.withColumn("part", range_part(F.col("key"), bounds)) if bounds else keyed.withColumn("part", F.lit(0))
    # one number a range: at most as many rows as there are ranges
    sums = dict(keyed.groupBy("part").agg(F.sum("n")).collect())
    starts, at = {}, 0
    for p in sorted(sums):
        starts[p], at = at, at + sums[p]
    return (
        keyed.repartition(-(-(len(bounds) + 1) // 4), "part")  # a task holds about four ranges
        .sortWithinPartitions("part", "key", "doc_id", F.crc32("ids"))
        .select("part", "doc_id", "n", "ids")
        .mapInArrow(tidied(_cut(starts, seq_len, _width(tokenizer or default_tokenizer()))), PIECES)
    )


@lru_cache(maxsize=2)
def _width(tokenizer: str) -> int:
    return _encoder(tokenizer).width


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as read from the files of the stage before, packed in their
    order window by window."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not read from files
        return packed(docs)
    return packed(in_files(docs))


ORACLE_SQL = None
