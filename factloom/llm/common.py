"""Shared pieces of the training-data operators: shared scratch space and vectorised text hashing.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; texts are handled as the UTF-8 bytes of an
Arrow column, so a batch of documents is cut and hashed in numpy without a Python object per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in pieces of about so many bytes, so memory doesn't follow the batch size.
CHUNK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 5
_powers: dict[tuple[int, int], np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one only where none is set and all runs in one process (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not shared:
        shared = sc.getCheckpointDir()
        if not shared and (sc.master != "local" and not sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not shared:
            shared = "file://" + tempfile.mkdtemp(prefix="factloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage with files that every executor can read again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a broadcast side at most (narrow rows of ids and counts, a few MB); larger sides are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Rows of a partition of a small checkpointed frame.
PART_ROWS = 20_000


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A reliable checkpoint of df and its number of rows; few rows are read again by few tasks."""
    out = cut(df)
    n = out.count()
    return (out.coalesce(n // PART_ROWS + 1) if n < 10 * PART_ROWS else out), n


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if so many rows (counted, or a bound) are few."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver's JVM find unreachable plans, so that Spark deletes their shuffle files now."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


_kept: dict = {}


def kept(key, make):
    """One large object at a time for each Python worker: what another operator left there goes first."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Frees what another operator left in this Python worker, which Spark uses again; for functions that keep nothing."""
    if _kept:
        _kept.clear()
        _powers.clear()
        pa.default_memory_pool().release_unused()


#: Bytes of an Arrow batch of texts at most, in the JVM and in the worker.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound for Arrow batches: whole texts are long, and a batch is held several times on its way."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(name, str(BATCH_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(mult: int, n: int) -> np.ndarray:
    """mult**i mod 2**64 for i < n, grown and kept."""
    got = _powers.get((mult, 0))
    if got is None or len(got) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        got = np.full(size, mult & 0xFFFFFFFFFFFFFFFF, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[mult, 0] = got
    return got[:n]


def _inverse(mult: int) -> int:
    return pow(mult, -1, 1 << 64)


def ranges_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray, mult: int = _MULT) -> np.ndarray:
    """A 64-bit hash of values[begin[i]:end[i]] for each i, from one running polynomial sum."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(mult, len(values)), out=sums[1:])
    out = (sums[end] - sums[begin]) * powers(_inverse(mult), len(values) + 1)[begin]
    out += (end - begin).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return mix(out)


def windows_hash(words: np.ndarray, k: int, mult: int = _MULT) -> np.ndarray:
    """Hash of each run of k consecutive values; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    begin = np.arange(n)
    return ranges_hash(words, begin, begin + k, mult)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(raw: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, bytes, offsets) of runs of documents of about limit bytes; a longer document is alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """The words of some documents: begin and end in raw, and per document the first word's index (first has n + 1 entries)."""

    __slots__ = ("begin", "end", "first", "off", "raw")

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = False):
        self.raw = _LOWER[raw] if lower else raw
        self.off = off
        inside = ~_SPACE[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = off[:-1] < off[1:]
        before[off[:-1][full]] = False
        after[off[1:][full] - 1] = False
        self.begin = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.begin, off)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return ranges_hash(self.raw.astype(np.uint64) + _U(1), self.begin, self.end)


def per_document_windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word of each window of k words that lies in one document, that document's index)."""
    n = np.diff(first)
    have = np.maximum(n - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), have)
    ahead = np.concatenate([[0], np.cumsum(have)[:-1]]) if len(have) else np.empty(0, np.int64)
    return np.arange(len(doc)) - np.repeat(ahead, have) + np.repeat(first[:-1], have), doc
