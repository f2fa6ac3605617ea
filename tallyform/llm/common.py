"""Shared kernels of the training-data operators: scratch tables, Arrow text access, word hashing.

Everything here is vectorised over Arrow batches; no function holds more than one slice of rows.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; a single longer row forms a slice of its own.
SLICE_BYTES = 1 << 19

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_BASE = 0xD6E8FEB86659FD93
_WORD_BASE = 0xA0761D6478BD642F

#: Bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes or words that are hashed at once; their partial sums take eight times as many bytes.
HASHED = 1 << 20

_own_dirs: list[tuple[SparkSession, str]] = []


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset (as in tests), one of our own.

    That is a folder of the machine, which only a local master can share with itself; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallyform-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def _drop_own() -> None:
    for spark, path in _own_dirs:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch space
            pass


atexit.register(_drop_own)


def own_folder(spark: SparkSession, path: str) -> str:
    """path, which is removed when the driver's Python ends."""
    _own_dirs.append((spark, path))
    return path


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new path in the shared scratch folder, removed when the driver's Python ends."""
    return own_folder(spark, f"{scratch_root(spark)}/tallyform/{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage is cut and lost executors cost nothing.

    The folder, with one folder in it for each value of `by`, is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch_table(spark, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean_batches(spark: SparkSession, size: str = "8m") -> None:
    """Hand whole texts to Python in smaller Arrow batches, unless the session has its own limit.

    With the default of 64 MB a batch, its copies on both sides take more memory than the kernels.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, "67108864b") in ("67108864b", "64m"):
        spark.conf.set(limit, size)


def give_back() -> None:
    """Return freed memory of a Python worker to the system; workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def discard(df: DataFrame, tables: list[DataFrame]) -> None:
    """Remove scratch tables that no later result reads."""
    for t in tables:
        for f in t.inputFiles()[:1]:
            path = f.rsplit("/", 1)[0]
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id="doc_id"):
    """True where crc32 of doc_id as text is divisible by five; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


# ---------------------------------------------------------------- Arrow text


def utf8_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its row offsets, without a copy; nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if not len(arr) or off is None:
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, off


def row_bytes(arr: pa.Array) -> list[bytes]:
    raw, off = utf8_view(arr)
    if not len(raw):
        return [b""] * len(arr)
    view = memoryview(raw)
    return [bytes(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


# ---------------------------------------------------------------- hashing


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inv, k, 1 << 64))])
        return self.up, self.down


_bytes_pow, _words_pow = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and, per row, the number of its first word; data starts at offsets[0] == 0."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(rows + 1, np.int64)
    isw = ~is_sep[data]
    first, last = isw.copy(), isw.copy()
    first[1:] &= ~isw[:-1]
    last[:-1] &= ~isw[1:]
    full = offsets[1:] > offsets[:-1]
    a, b = offsets[:-1][full], offsets[1:][full] - 1
    first[a[isw[a]]] = True
    last[b[isw[b]]] = True
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a polynomial over its bytes modulo 2^64, then mixed with its length.

    A hash does not depend on where its word stands, so words are taken HASHED bytes at a time.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + HASHED, "right")))
        s, e = start[i:j] - start[i], end[i:j] - start[i]
        part = data[start[i] : end[j - 1]]
        up, down = _bytes_pow.to(min(len(part), HASHED) + 1) if len(part) <= HASHED else _Powers(_BYTE_BASE).to(len(part) + 1)
        c = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=c[1:])
        out[i:j] = mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64) * _GOLD)
        i = j
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive word hashes (window i starts at word i), HASHED windows at a time."""
    n = max(len(h) - k + 1, 0)
    out = np.empty(n, np.uint64)
    for i in range(0, n, HASHED):
        part = h[i : min(i + HASHED, n) + k - 1]
        up, down = _words_pow.to(len(part) + 1)
        c = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=c[1:])
        out[i : i + HASHED] = mix((c[k:] - c[:-k]) * down[: len(part) - k + 1])
    return out


def sort_groups(key: np.ndarray) -> np.ndarray:
    """A stable order that brings equal 64-bit keys together; keys of one group keep their input order.

    Sorts packed values (high key bits, position), which is several times as fast as argsort, and
    falls back to argsort in the rare case that different keys share the kept bits.
    """
    n = len(key)
    bits = np.uint64(max(1, int(n - 1).bit_length())) if n > 1 else np.uint64(1)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    packed = (key & ~mask) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & mask).astype(np.int64)
    top = packed & ~mask
    k = key[order]
    if n > 1 and np.any((top[1:] == top[:-1]) & (k[1:] != k[:-1])):
        order = np.argsort(key, kind="stable")
    return order
