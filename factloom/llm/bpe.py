"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

A text is cut by the tokenizer's pattern; each distinct piece is encoded once per task memory. Pieces of similar byte
length form one padded matrix of ids. In each round every row finds its adjacent pair of least rank (the leftmost at a
tie) through a hashed pair table, merges it and compacts; rows without a mergeable pair leave. A piece of more than LONG
bytes would take as many rounds as it has bytes: its pairs wait in a heap by rank and place instead, which merges in the same
order, in time that grows with n log n. Decoding gathers the ids' bytes from one flat table.

Defined cases: null text is empty and gives no ids; texts of any length are encoded whole; rows are independent.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Distinct chunks whose ids a worker keeps; beyond it the half that was met least goes (results don't change).
MEMORY_CHUNKS = 250_000
#: Cells of one padded matrix.
MATRIX_CELLS = 1 << 19
#: Bytes of a piece from which its merges are ordered by a heap.
LONG = 512
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_NONE = np.int32(0x7FFFFFFF)
_SPACED_SPACE = re.compile(r" \s")


def _default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _gather(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[at[i]:at[i] + size[i]] one behind the other."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return pool[np.arange(total) + np.repeat(at - (end - size), size)]


def _packed(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arrays joined, and each one's length and place."""
    size = np.array([len(x) for x in arrays], np.int64)
    return (np.concatenate(arrays) if arrays else np.empty(0, np.int32)), size, np.cumsum(size) - size


class ChunkMemory:
    """Ids of the chunks seen so far.

    A text is cut before each space between two words, where the pattern always ends a match, so the chunks' ids join to the
    text's. A text with other spacing (a space beside white space, or at an end) is one chunk.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.heads: dict[str, int] = {}
        self.spaced: dict[str, int] = {}  # without the space before them
        self.n = 0
        self.kept, self.at, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.met = np.empty(0, np.int64)

    def _shrink(self) -> None:
        """Keeps the chunks met most, half the limit of them, and halves their counts."""
        keep = np.zeros(self.n, bool)
        keep[np.argsort(self.met, kind="stable")[-(self.limit // 2) :]] = True
        new = (np.cumsum(keep) - 1).tolist()
        stays = keep.tolist()
        self.heads = {c: new[k] for c, k in self.heads.items() if stays[k]}
        self.spaced = {c: new[k] for c, k in self.spaced.items() if stays[k]}
        self.kept = _gather(self.kept, self.at[keep], self.size[keep])
        self.size = self.size[keep]
        self.at = np.cumsum(self.size) - self.size
        self.met = self.met[keep] // 2
        self.n = len(self.size)

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[int]]:
        codes: list[int] = []
        names: list[str] = []
        counts: list[int] = []
        head, spaced = self.heads.get, self.spaced.get
        for t in texts:
            if not t:
                counts.append(0)
                continue
            parts = [t] if t[0] == " " or t[-1] == " " or _SPACED_SPACE.search(t) else t.split(" ")
            names += parts
            counts.append(len(parts))
            codes.append(head(parts[0], -1))
            parts[0] = ""
            codes.extend(map(spaced, parts, repeat(-1)))
        return np.array(codes, np.int64), names, counts

    def encode(self, texts: list[str], learn) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids); learn(chunks) gives (ids of all, number of each) of new chunks."""
        # a head's place in codes is followed by one for the empty name that stands for it among the spaced ones
        if self.n > self.limit:
            self._shrink()
        codes, names, counts = self._codes(texts)
        per = np.array(counts, np.int64)
        full = per[per > 0]
        heads = np.cumsum(full + 1) - full - 1
        keep = np.ones(len(codes), bool)
        keep[heads + 1] = False
        is_head = np.zeros(len(codes), bool)
        is_head[heads] = True
        codes, is_head = codes[keep], is_head[keep]
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new, lead = [names[i] for i in missing.tolist()], is_head[missing]
            first = lead.tolist()
            fresh_heads = list(dict.fromkeys(compress(new, first))) if lead.any() else []
            fresh = list(dict.fromkeys(compress(new, (~lead).tolist()) if fresh_heads else new))
            flat, size = learn(fresh_heads + [" " + x for x in fresh])
            self.at = np.concatenate([self.at, np.cumsum(size) - size + len(self.kept)])
            self.size = np.concatenate([self.size, size])
            self.kept = np.concatenate([self.kept, flat])
            self.heads.update(zip(fresh_heads, range(self.n, self.n + len(fresh_heads)), strict=True))
            self.spaced.update(zip(fresh, range(self.n + len(fresh_heads), self.n + len(fresh_heads) + len(fresh)), strict=True))
            self.n += len(size)
            self.met = np.concatenate([self.met, np.zeros(len(size), np.int64)])
            codes[missing] = [self.heads[x] if h else self.spaced[x] for x, h in zip(new, first, strict=True)] if fresh_heads else list(map(self.spaced.__getitem__, new))
        self.met += np.bincount(codes, minlength=self.n)
        size = self.size[codes]
        sums = np.concatenate([[0], np.cumsum(size)])
        return _gather(self.kept, self.at[codes], size), np.diff(sums[np.cumsum(per)], prepend=0)


class PairTable:
    """Open-addressing table from a pair of ids to the id of their merge (its rank)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(len(left) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        todo, where = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), None
        vals = merged.astype(np.int32)
        where = self._slot(todo)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[where] == _EMPTY
            self.keys[where[free]] = todo[free]  # of several keys for one slot, the last stays
            won = self.keys[where] == todo
            self.values[where[won]] = vals[won]
            todo, vals, where = todo[~won], vals[~won], (where[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a value above every rank."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        where = self._slot(keys)
        out = np.full(keys.shape, _NONE, np.int32)
        open_ = np.arange(keys.size)
        flat_out, flat_keys, where = out.reshape(-1), keys.reshape(-1), where.reshape(-1)
        for _ in range(self.probes + 1):
            there = self.keys[where]
            hit = there == flat_keys[open_]
            flat_out[open_[hit]] = self.values[where[hit]]
            on = ~hit & (there != _EMPTY)
            open_, where = open_[on], (where[on] + 1) & self.mask
            if not len(open_):
                break
        return out


def _split(token: bytes, ranks: dict[bytes, int], limit: int) -> tuple[int, int] | None:
    """The two ids whose merge gives the token: what its bytes become by merges of lower rank."""
    parts = [ranks[bytes([b])] for b in token]
    words = [bytes([b]) for b in token]
    while len(words) > 2:
        best, at = limit, -1
        for i in range(len(words) - 1):
            r = ranks.get(words[i] + words[i + 1], limit)
            if r < best:
                best, at = r, i
        if at < 0:
            return None
        words[at : at + 2] = [words[at] + words[at + 1]]
        parts[at : at + 2] = [best]
    return (parts[0], parts[1]) if len(words) == 2 else None


class ByteBPE:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        fs, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        with fs.open_input_stream(inner) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines() if x)}
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = {t: r for t, r in ranks.items()}
        pairs = [(*p, r) for t, r in ranks.items() if len(t) > 1 and (p := _split(t, ranks, r)) is not None]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged)
        self.merge_of = None
        top = max(ranks.values()) + 1
        table = [b""] * top
        for t, r in ranks.items():
            table[r] = t
        self.table = table
        self.size = np.array([len(t) for t in table], np.int64)
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.text_of = [str(i) for i in range(top)]
        self.memory = ChunkMemory(MEMORY_CHUNKS)

    def _merge_rows(self, m: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """m: rows of byte ids padded at the right; the ids of each row after all merges."""
        out: list[np.ndarray] = [None] * len(m)  # type: ignore[list-item]
        rows = np.arange(len(m))
        while len(rows):
            width = int(length.max())
            m = m[:, :width]
            inside = np.arange(1, width) < length[:, None]
            rank = np.full((len(m), max(width - 1, 1)), _NONE, np.int32)
            if width > 1:
                rank[inside] = self.pairs.lookup(m[:, :-1][inside], m[:, 1:][inside])
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(m)), at]
            done = best == _NONE
            for i in np.flatnonzero(done).tolist():
                out[rows[i]] = m[i, : length[i]].copy()
            go = ~done
            rows, m, length, at, best = rows[go], m[go], length[go], at[go], best[go]
            if len(rows):
                keep = np.ones(m.shape, bool)
                keep[np.arange(len(m)), at + 1] = False
                m[np.arange(len(m)), at] = best
                m = m[keep].reshape(len(m), -1)
                length = length - 1
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: the leftmost pair of least rank is merged until none is left."""
        if self.merge_of is None:  # few workers ever need it
            used = np.flatnonzero(self.pairs.keys != _EMPTY)
            self.merge_of = dict(zip(self.pairs.keys[used].tolist(), self.pairs.values[used].tolist(), strict=True))
        get, n = self.merge_of.get, len(piece)
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, by buckets of equal rounded length."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.whole.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[i] = self._merge_long(p)
            else:
                n = len(p)
                buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // max(width, 1))
            for k in range(0, len(members), step):
                some = members[k : k + step]
                length = np.array([len(pieces[i]) for i in some], np.int64)
                m = np.zeros((len(some), int(length.max())), np.int32)
                m[np.arange(m.shape[1]) < length[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)]
                for i, ids in zip(some, self._merge_rows(m, length), strict=True):
                    out[i] = ids
        return out

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.pattern.findall(c) for c in chunks]
        distinct = list({p for f in found for p in f})
        code = {p: i for i, p in enumerate(distinct)}
        pool, size, at = _packed(self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in distinct]))
        each = np.array([len(f) for f in found], np.int64)
        codes = np.fromiter((code[p] for f in found for p in f), np.int64, int(each.sum()))
        sums = np.concatenate([[0], np.cumsum(size[codes])])
        return _gather(pool, at[codes], size[codes]), np.diff(sums[np.cumsum(each)], prepend=0)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        flat, n = self.memory.encode(texts, self._learn)
        ends = np.cumsum(n)
        return [flat[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.flat, self.at[ids], self.size[ids]).tobytes()


def coder(path: str, pattern: str) -> ByteBPE:
    return C.kept(("bpe", path, pattern), lambda: ByteBPE(path, pattern))


def _groups(texts: pa.Array, limit: int = C.CHUNK_BYTES):
    """Lists of texts of about limit bytes."""
    some: list[str] = []
    held = 0
    for t in texts:
        s = t.as_py() or ""
        some.append(s)
        held += len(s)
        if held > limit:
            yield some
            some, held = [], 0
    if some:
        yield some


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(id, ids array<int>) of every row."""
    path, pattern = vocabulary or _default_vocabulary()

    def run(batches):
        bpe = coder(path, pattern)
        for b in batches:
            at = 0
            for some in _groups(b.column(1)):
                ids = bpe.encode_batch(some)
                lengths = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(ids)))], ["id", "ids"])
                at += len(some)

    C.bounded_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {key}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(id, decoded binary) of every row of ids."""
    path, pattern = vocabulary or _default_vocabulary()

    def run(batches):
        bpe = coder(path, pattern)
        for b in batches:
            out = [bpe.decode(np.asarray(x.as_py() or [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    key = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {key}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes every text and decodes its ids in one pass: id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for."""
    path, pattern = vocabulary or _default_vocabulary()

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches):
        bpe = coder(path, pattern)
        for b in batches:
            at = 0
            for some in _groups(b.column(1)):
                every = bpe.encode_batch(some)
                n = np.array([len(ids) for ids in every], np.int64)
                ids_sha = [hashlib.sha256(" ".join(map(bpe.text_of.__getitem__, ids.tolist())).encode()).hexdigest() for ids in every]
                back_sha = [hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in every]
                columns = [b.column(0).slice(at, len(some)), pa.array(n), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(np.concatenate(every))))
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(some)

    C.bounded_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    fields = f"id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, fields).withColumnRenamed("id", id_col)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(C.documents(spark, sf_dir))


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLE = {}
