"""Substring dedup: words inside repeated windows of WINDOW words go.

Every window has an anchor: the leftmost of the k-word grams inside it whose hash is least, so equal windows have equal
anchors at different places. Pass one counts anchor places in count-min sketches of fixed size, one for each part of a
partition, merged block by block. A window occurs at most as often as its anchor, and the sketch never counts less, so
pass two leaves only windows whose anchor is counted once: none of them can be repeated. All others are grouped exactly
by their 64-bit hash (64 bits tell the windows of a corpus apart but for about n**2 / 2**65 chance pairs).

The sketch is sized from the bytes of the corpus, counted first: about CELLS_EACH cells for an expected anchor in each of SKETCH_ROWS
rows, between 2**LEAST_BITS and 2**MOST_BITS cells (a bit for each goes to the workers, 64 MB at most). Beyond what the largest
one holds its counts get coarser and more windows are grouped exactly, with the same result.

Defined cases: null text has no words; a text of fewer words than a window is left alone; windows are judged on the input,
inside one document too; repeated rows of one document are repeats of each other; other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 35
GRAM = 10
SKETCH_ROWS = 4
#: Exponents of the least and largest number of cells of a sketch's row, and cells for each anchor expected.
LEAST_BITS, MOST_BITS = 22, 27
CELLS_EACH = 2
#: Bytes of text for one anchor, about: 13 words of 6.
BYTES_EACH = 80
#: Cells of a block: the unit in which sketches are merged.
BLOCK_BITS = 16
#: Anchors after which a partition hands on a sketch, so that its memory is bounded.
FLUSH = 1 << 21
_MULTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if have < width else m


class Windows:
    """The windows of some documents: start word, document, and the anchor's place and hash."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.words = C.Words(raw, off)
        self.starts, self.doc = C.per_document_windows(self.words.first, window)
        if len(self.starts):
            self.hashes = self.words.hashes()
            grams = C.windows_hash(self.hashes, gram)
            packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
            place = _sliding_min(packed, window - gram + 1)[self.starts] & np.uint64(0xFFFFFFFF)
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            self.anchors = grams[place[new].astype(np.int64)]
            self.anchor_of = np.cumsum(new) - 1
        else:
            self.anchors = np.empty(0, np.uint64)


def sketch_bits(n_bytes: int) -> int:
    """Exponent of the cells of a row for a corpus of so many bytes."""
    return min(MOST_BITS, max(LEAST_BITS, (n_bytes // BYTES_EACH * CELLS_EACH).bit_length()))


def _cells(anchors: np.ndarray, row: int, size: int) -> np.ndarray:
    return ((anchors * _MULTS[row]) >> np.uint64(64 - size)).astype(np.int64)


def _sketch(anchors: np.ndarray, size: int) -> pa.RecordBatch:
    rows, blocks, once, more = [], [], [], []
    for r in range(SKETCH_ROWS):
        cells, counts = np.unique(_cells(anchors, r, size), return_counts=True)
        block = cells >> BLOCK_BITS
        cuts = np.searchsorted(block, np.arange((1 << (size - BLOCK_BITS)) + 1))
        low = (cells & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part, n = low[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]
            rows.append(r)
            blocks.append(b)
            once.append(part[n == 1].tobytes())
            more.append(part[n > 1].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["r", "block", "once", "more"])


def _merged(key, frame):
    import pandas as pd

    count = np.zeros(1 << BLOCK_BITS, np.uint8)
    for once, more in zip(frame["once"], frame["more"], strict=True):
        at = np.frombuffer(once, np.uint16)
        count[at] = np.minimum(count[at] + 1, 2)
        count[np.frombuffer(more, np.uint16)] = 2
    return pd.DataFrame({"r": [key[0]], "block": [key[1]], "bits": [np.packbits(count > 1).tobytes()]})


def repeated_cells(keyed: DataFrame, window: int, gram: int, size: int) -> np.ndarray:
    """Bit arrays (SKETCH_ROWS x 2**size / 8 bytes): cells counted twice or more over all documents."""

    def run(batches):
        C.release()
        held, n = [], 0
        for b in batches:
            raw, off = C.utf8(b.column(1))
            for _, _, part, at in C.pieces(raw, off):
                held.append(Windows(part, at, window, gram).anchors)
                n += len(held[-1])
                if n >= FLUSH:
                    yield _sketch(np.concatenate(held), size)
                    held, n = [], 0
        if n:
            yield _sketch(np.concatenate(held), size)

    parts = keyed.select("k", "text").mapInArrow(run, "r int, block int, once binary, more binary")
    out = np.zeros((SKETCH_ROWS, 1 << (size - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for row in parts.groupBy("r", "block").applyInPandas(_merged, "r int, block int, bits binary").toLocalIterator():
        out[row.r, row.block] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(SKETCH_ROWS, -1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeated_starts(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k, starts array<int>): the first words of every document's repeated windows. keyed: (k, text)."""
    spark = keyed.sparkSession
    size = sketch_bits(keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = spark.sparkContext.broadcast(repeated_cells(keyed, window, gram, size))

    def candidates(batches, placed: bool):
        C.release()
        sketch = bits.value
        for b in batches:
            raw, off = C.utf8(b.column(1))
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, part, at in C.pieces(raw, off):
                w = Windows(part, at, window, gram)
                if not len(w.anchors):
                    continue
                again = np.ones(len(w.anchors), bool)
                for r in range(SKETCH_ROWS):
                    cell = _cells(w.anchors, r, size)
                    again &= (sketch[r][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
                some = again[w.anchor_of]
                starts = w.starts[some]
                if not len(starts):
                    continue
                h = C.windows_hash(w.hashes, window)[starts]
                if placed:
                    doc = w.doc[some]
                    yield pa.RecordBatch.from_arrays([_signed(h), pa.array(keys[i + doc]), pa.array((starts - w.words.first[doc]).astype(np.int32))], ["h", "k", "start"])
                else:
                    h, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([_signed(h), pa.array(n.astype(np.int64))], ["h", "n"])

    source = keyed.select("k", "text")
    counted = source.mapInArrow(lambda it: candidates(it, False), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = C.cut(counted.where("n > 1").select("h"))
    C.free_shuffles(spark)
    placed = source.mapInArrow(lambda it: candidates(it, True), "h long, k long, start int")
    return placed.join(repeated, "h").groupBy("k").agg(F.collect_set("start").alias("starts"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(row struct of all input columns, kept_text, n_words, n_removed) for every input row; kept words are joined by one space."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = docs.select(key.alias("k"), F.col(text_col).alias("text"))
    marks = C.cut(repeated_starts(keyed, window, gram))
    C.free_shuffles(spark)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"))
    both = whole.join(marks, "k", "left").select("row", "starts")  # the text goes once, inside its row

    def run(batches):
        C.release()
        for b in batches:
            raw, off = C.utf8(b.column(0).field(text_col))
            starts = b.column(1)
            kept, n_words, n_removed = [], [], []
            for i, j, part, at in C.pieces(raw, off):
                w = C.Words(part, at)
                for d in range(j - i):
                    a, z = int(w.first[d]), int(w.first[d + 1])
                    words = part[at[d] : at[d + 1]].tobytes().split()
                    gone = 0
                    mine = starts[i + d]
                    if mine.is_valid:
                        edge = np.zeros(z - a + 1, np.int32)
                        s = np.asarray(mine.values)
                        edge[s] += 1
                        edge[s + window] -= 1
                        cover = np.cumsum(edge[:-1]) > 0
                        gone = int(cover.sum())
                        words = [x for x, c in zip(words, cover.tolist(), strict=True) if not c]
                    kept.append(b" ".join(words).decode())
                    n_words.append(z - a)
                    n_removed.append(gone)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["row", "kept_text", "n_words", "n_removed"])

    return both.mapInArrow(run, f"row {both.schema['row'].dataType.simpleString()}, kept_text string, n_words long, n_removed long")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = substring_dedup(C.documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
ORACLE = {
    "op10_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d WHERE len(w) >= {WINDOW})),
again AS (SELECT t FROM g GROUP BY t HAVING count(*) > 1),
m AS (SELECT r, list(s) AS starts FROM g SEMI JOIN again USING (t) GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s, s + {WINDOW})) AS p FROM (SELECT r, unnest(starts) AS s FROM m)),
x AS (SELECT d.r, d.doc_id, unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS p FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM x ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""
}
QUERIES = {"op10_substring_dedup": op10_substring_dedup}
