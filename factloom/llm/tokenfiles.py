"""Token-id files: one wavelet matrix per shard.

Texts are encoded with the tokenizers library, each document closed by END, and written in ascending doc_id order. A shard's
ids are stored as bit planes, highest bit first, each plane ordered by the bits above it (zeros, then ones). Counts of
ones before every block of BLOCK bits answer rank; select searches them. One file holds header, documents, planes and
counts, and answers access(i), rank(id, i), count(id) and select(id, k) without the plain ids: open_shard() reads the header and
the counts, and of the planes only the frames that an answer needs.

File: MAGIC, the header's length as a little-endian 64-bit integer, the header (JSON: sizes, zeros of each plane, place and length
of every section and frame), then zstd frames: document ends, document ids, counts, and each plane in frames of FRAME bytes.

Defined cases: null text is empty and gives END alone; rows of one doc_id are ordered by their text, equal rows are
equal; documents without id come first; an empty table writes no files and gives an empty result. Shards are cut by ranges of doc_id, so
each fits a task; a file is written under a name of its own and counts only if its task ends, so a repeated task is harmless.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .bpe import ChunkMemory, _groups

END = 2
MAGIC = b"WVMX0002"
BLOCK = 512
#: Bytes of a plane in one zstd frame: what a single lookup inflates of it. A multiple of BLOCK / 8.
FRAME = 1 << 15
MEMORY_CHUNKS = 600_000
#: Texts handed to the library at once (its encodings are large), and chunks joined to one of them.
LEARN_TEXTS = 64
LEARN_CHUNKS = 64
#: Tokens of a shard at most; a task with more writes several.
SHARD_TOKENS = 1 << 22


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WaveletMatrix:
    """Rank, select and access over bit planes."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ones: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ones = n, planes, zeros, ones

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        width = max(1, int(ids.max()).bit_length()) if n else 1
        a = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros, ones = [], [], []
        for level in range(width - 1, -1, -1):
            mask = (a & a.dtype.type(1 << level)) != 0
            packed = np.packbits(mask)
            pad = -len(packed) % (BLOCK // 8)
            per_block = np.bitwise_count(np.pad(packed, (0, pad)).reshape(-1, BLOCK // 8)).sum(axis=1)
            planes.append(packed)
            ones.append(np.concatenate([[0], np.cumsum(per_block)]).astype(np.int64))
            low = np.compress(~mask, a)
            zeros.append(len(low))
            a = np.concatenate([low, np.compress(mask, a)])
        return cls(n, planes, zeros, ones)

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i >> 3]) >> (7 - (i & 7))) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block = i // BLOCK
        at = block * (BLOCK // 8)
        n = int(self.ones[level][block])
        whole = self.planes[level][at : i >> 3]
        n += int(np.bitwise_count(whole).sum())
        return n + (int(self.planes[level][i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else n

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            value = value << 1 | bit
            r = self._rank1(level, i)
            i = self.zeros[level] + r if bit else i - r
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the first i positions' occurrences of value end up in the lowest order: (begin, end)."""
        a, b = 0, i
        if value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            if value >> (len(self.planes) - 1 - level) & 1:
                a, b = self.zeros[level] + ra, self.zeros[level] + rb
            else:
                a, b = a - ra, b - rb
        return a, b

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value before position i."""
        a, b = self._range(value, i)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value in a plane."""
        ones = self.ones[level]
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of value; -1 if there are fewer."""
        a, b = self._range(value, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the lowest."""
        width = len(self.planes)
        a = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for level in range(width - 1, -1, -1):
            mask = np.unpackbits(self.planes[level][:], count=self.n).view(bool)
            b = np.empty_like(a)
            b[np.flatnonzero(~mask)] = a[: self.zeros[level]]
            b[np.flatnonzero(mask)] = a[self.zeros[level] :] | a.dtype.type(1 << (width - 1 - level))
            a = b
        return a

    def access_many(self, at: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        at, value = at.astype(np.int64), np.zeros(len(at), np.int64)
        for level in range(len(self.planes)):
            plane = self.planes[level][:]
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)])
            byte, inside = plane[at >> 3].astype(np.int64), at & 7
            bit = (byte >> (7 - inside)) & 1
            ones = before[at >> 3] + np.bitwise_count(byte >> (8 - inside))
            value = value << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return value


def _fs(path: str):
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_shard(path: str, ids: np.ndarray, doc_ends: np.ndarray, doc_ids: list) -> None:
    import zstandard

    w = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [doc_ends.astype("<i8").tobytes(), json.dumps(doc_ids).encode(), b"".join(o.astype("<u4").tobytes() for o in w.ones)]
    frames = [pack(x) for x in parts] + [pack(p[i : i + FRAME].tobytes()) for p in w.planes for i in range(0, len(p), FRAME)]
    header = json.dumps({"n": w.n, "width": len(w.planes), "zeros": w.zeros, "docs": len(doc_ids), "block": BLOCK, "frame": FRAME, "sizes": [len(x) for x in frames]}).encode()
    fs, inner = _fs(path)
    with fs.open_output_stream(inner) as f:
        f.write(MAGIC + len(header).to_bytes(8, "little") + header + b"".join(frames))


class _Plane:
    """Bytes of a plane, inflated frame by frame as they are asked for."""

    def __init__(self, length: int, frame: int, load):
        self.length, self.frame, self.load = length, frame, load
        self.held: dict[int, np.ndarray] = {}

    def _frame(self, k: int) -> np.ndarray:
        if k not in self.held:
            self.held[k] = np.frombuffer(self.load(k), np.uint8)
        return self.held[k]

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, key):
        if isinstance(key, slice):
            a, b, _ = key.indices(self.length)
            parts = [self._frame(k)[max(0, a - k * self.frame) : b - k * self.frame] for k in range(a // self.frame, -(-b // self.frame))] if b > a else []
            return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint8), *parts])
        return self._frame(key // self.frame)[key % self.frame]


def open_shard(path: str) -> tuple[WaveletMatrix, np.ndarray, list]:
    """(matrix, end of each document in ids, doc ids); the matrix reads the file's planes as it is asked."""
    import zstandard

    fs, inner = _fs(path)
    f = fs.open_input_file(inner)
    first = f.read(len(MAGIC) + 8)
    if first[: len(MAGIC)] != MAGIC:
        raise ValueError(f"not a wavelet shard: {path}")
    n_head = int.from_bytes(first[len(MAGIC) :], "little")
    h = json.loads(f.read(n_head))
    at = np.concatenate([[0], np.cumsum(h["sizes"])]) + len(first) + n_head
    unpack = zstandard.ZstdDecompressor().decompress
    frame = lambda k: unpack(f.read_at(h["sizes"][k], int(at[k])))
    size = -(-h["n"] // 8)
    each, blocks = -(-size // h["frame"]), -(-size // (h["block"] // 8)) + 1
    planes = [_Plane(size, h["frame"], lambda k, level=level: frame(3 + level * each + k)) for level in range(h["width"])]
    ones = np.frombuffer(frame(2), "<u4").reshape(h["width"], blocks).astype(np.int64)
    return WaveletMatrix(h["n"], planes, h["zeros"], list(ones)), np.frombuffer(frame(0), "<i8"), json.loads(frame(1))


class Encoder:
    """The library's encoder with a memory of chunks: texts are cut before a single space between two words, where its pattern always ends a match."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        from tokenizers import Tokenizer

        fs, inner = _fs(path)
        with fs.open_input_stream(inner) as f:
            self.tokenizer = Tokenizer.from_str(f.read().decode())
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.model._resize_cache(0)  # what comes here is new to the memory below
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(names.values(), default=0) + 1, np.int64)
        self.bytes_of[list(names.values())] = [len(x) for x in names]  # a character of a name stands for a byte
        self.memory = ChunkMemory(MEMORY_CHUNKS)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for i in range(0, len(texts), LEARN_TEXTS) for x in self.tokenizer.encode_batch_fast(texts[i : i + LEARN_TEXTS], add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks behind a space are joined to long texts, as the library's cost for a text is that of several words; their ids
        are parted again where the ids' bytes reach the chunks' ends."""
        at = next((i for i, c in enumerate(chunks) if c[0] == " "), len(chunks))
        at = max(at, next((len(chunks) - i for i, c in enumerate(reversed(chunks)) if c[0] != " "), 0))
        ids = [np.array(x, np.int32) for x in self._library(chunks[:at])]
        size = [np.array([len(x) for x in ids], np.int64)]
        for i in range(at, len(chunks), LEARN_CHUNKS * LEARN_TEXTS):
            groups = [chunks[k : k + LEARN_CHUNKS] for k in range(i, min(i + LEARN_CHUNKS * LEARN_TEXTS, len(chunks)), LEARN_CHUNKS)]
            for group, got in zip(groups, self._library(["".join(g) for g in groups]), strict=True):
                got = np.array(got, np.int32)
                ends = np.cumsum(list(map(len, map(str.encode, group))))
                reached = np.cumsum(self.bytes_of[got])
                last = np.searchsorted(reached, ends)
                if last[-1] >= len(reached) or (reached[last] != ends).any():
                    raise ValueError("the library joined ids across a space")
                ids.append(got)
                size.append(np.diff(last + 1, prepend=0))
        return np.concatenate([np.empty(0, np.int32), *ids]), np.concatenate(size)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by END; number of each text's ids)."""
        flat, n = self.memory.encode(texts, self._learn)
        out = np.full(len(flat) + len(texts), END, np.int32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(n + 1) - 1] = False
        out[keep] = flat
        return out, n + 1


def write_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Writes the shards; returns (part, piece, path, n_docs, n_tokens), in order of part and piece, of those that count."""
    vocabulary = vocabulary or _vocabulary()

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = C.kept(("encoder", vocabulary), lambda: Encoder(vocabulary))
        done, held, sizes, names, n = [], [], [], [], 0

        def flush():
            nonlocal held, sizes, names, n
            path = f"{folder}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.wvm"
            write_shard(path, np.concatenate(held), np.cumsum(np.concatenate(sizes)), names)
            done.append((part, len(done), path, len(names), n))
            held, sizes, names, n = [], [], [], 0

        for b in batches:
            keys, at = b.column(0).to_pylist(), 0
            for some in _groups(b.column(1)):
                ids, lengths = enc.encode(some)
                if n and n + len(ids) > SHARD_TOKENS:
                    flush()
                held.append(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids)
                sizes.append(lengths)
                names += keys[at : at + len(some)]
                at += len(some)
                n += len(ids)
        if names:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["part", "piece", "path", "n_docs", "n_tokens"])

    C.bounded_batches(docs.sparkSession)
    fs, inner = _fs(folder)
    fs.create_dir(inner, recursive=True)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    return C.cut(ordered.mapInArrow(run, "part long, piece long, path string, n_docs long, n_tokens long"))


def read_files(shards: DataFrame, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files alone."""
    spark = shards.sparkSession
    manifest = shards.orderBy("part", "piece").collect()  # a row for each file
    base, rows = 0, []
    for r in manifest:
        rows.append((r.path, base))
        base += r.n_tokens

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w, ends, names = open_shard(path)
                if (w.access_many(ends - 1) != END).any() or w.count(END) < len(names):
                    raise ValueError(f"a document isn't closed: {path}")
                ids = w.ids().astype("<u4")
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(id_type))
    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)), "path")
    return files.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op7_wavelet_shards(spark, sf_dir: str) -> DataFrame:
    return read_files(write_files(C.documents(spark, sf_dir), C.scratch(spark, "wavelet")))


QUERIES = {"op7_wavelet_shards": op7_wavelet_shards}
ORACLE = {}
