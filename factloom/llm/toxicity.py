"""Toxicity by noisy-channel deobfuscation.

Spans that look disguised (digits or signs in place of letters, letters spelled apart, letters repeated) become lattices of
what each character may stand for. Where a sign may as well be punctuation or plain spelling (at a word's end, two equal
letters, one separator inside), the word as it stands is kept beside its reading. Viterbi finds the likeliest reading under a character trigram model, counted over the
texts of the whole corpus; the restored words are then scored by word weights learned from the labels.

Every word met in the training texts has a weight: its log odds, drawn towards 0 as far as its counts leave them in doubt.
Weights lie in a table of 2**HASH_BITS cells by the word's hash, so its size is bounded however many words there are.

Labels are learned only from rows with crc32(doc_id as text) mod 5 other than 0, from TRAIN_ROWS of them at most, taken by
hash of the id; neither label, language, source nor id is an input of a score.

Defined cases: null or empty text has no marked word and gets the score of that; rows are scored alone; without labels of
both kinds every score is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TRAIN_ROWS = 20_000
#: Cells of the word table: 2**HASH_BITS weights of 4 bytes.
HASH_BITS = 20
SMOOTHING = 1.0
#: Standard errors of a word's log odds from which it counts fully, about: copies of a text make rare words look telling.
DOUBT = 8.0
MEMORY_WORDS = 60_000

#: What a sign may stand for.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}

_OTHER, _EDGE, _N = 26, 27, 28
#: Class of a code point: a letter a-z, another letter, or an edge. What lies beyond the table counts as a letter.
_CLASS = np.array([ord(c.lower()) - 97 if c.isascii() and c.isalpha() else _OTHER if c.isalpha() else _EDGE for c in map(chr, range(0x3000))], np.int64)

_DISGUISED = re.compile(r"[^\W\d_][0-9@$!|+*]+[^\W\d_]|^[0-9@$!|+]+[^\W\d_]{2}|([^\W\d_])\1\1|[^\W\d_][0-9]+$|[^\W_](?:[.\-_*~][^\W_]){2}")
#: Weaker signs, which plain words have as well: two equal letters, one inner separator.
_PERHAPS = re.compile(r"([^\W\d_])\1|[^\W_][.\-_*~][^\W_]")
#: Marks beside a word that stand for no letter.
_MARKS = ".,;:?()\"'"
_TWICE = re.compile(r"([^\W\d_])\1")
_EDGES = re.compile(r"^[^\w@$!|+]+|[^\w]+$")
#: As _EDGES, but signs in READINGS stay at the end.
_SIGNED = re.compile(r"^[^\w@$!|+]+|[^\w@$!|+*]+$")
_APART = re.compile(r"(?<!\S)[^\s]{1,2}(?:\s+[^\s]){2,}(?=[^\w\s]*(?!\S))")
_SEPARATOR = set(" \t.-_~*")


def _trigrams(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of the letter trigrams of some UTF-8 texts, each between edges."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off[:-1]]
    c = np.where(points < len(_CLASS), _CLASS[np.minimum(points, len(_CLASS) - 1)], _OTHER)
    c = np.insert(c, np.repeat(begins, 2), _EDGE)
    c = np.concatenate([c, [_EDGE]])
    return np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3)[: _N**3] if len(c) > 2 else np.zeros(_N**3, np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(cell, n): letter trigrams with edges over all texts; cell = (first * 28 + second) * 28 + third."""

    def run(batches):
        C.release()
        total = np.zeros(_N**3, np.int64)
        for b in batches:
            raw, off = C.utf8(b.column(0))
            for _, _, part, at in C.pieces(raw, off):
                total += _trigrams(part, at)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    C.bounded_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


class CharModel:
    """Trigram log probabilities, smoothed by bigrams and a uniform share."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(_N, _N, _N).astype(float)
        bi = tri.sum(axis=0)
        p2 = (bi + 0.5) / (bi + 0.5).sum(axis=1, keepdims=True)
        total = tri.sum(axis=2, keepdims=True)
        self.logp = np.log((tri + 4 * p2[None]) / (total + 4)).tolist()

    def restore(self, span: str, letter_at: int = -1) -> str:
        """The likeliest reading of a disguised span, with the sign at letter_at as a letter; words in it are parted by spaces."""
        states: dict[tuple[int, int], tuple[float, str]] = {(_EDGE, _EDGE): (0.0, "")}
        for options in _lattice(span, letter_at):
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, said) in states.items():
                for text, cost in options:
                    s, x, y = score - cost, a, b
                    for ch in text:
                        k = ord(ch) - 97 if "a" <= ch <= "z" else _EDGE if ch == " " else _OTHER
                        if k == _EDGE and y == _EDGE:
                            continue
                        s += self.logp[x][y][k]
                        x, y = (_EDGE, _EDGE) if k == _EDGE else (y, k)
                    old = new.get((x, y))
                    if old is None or s > old[0]:
                        new[x, y] = (s, said + text)
            states = new
        return max(((s + (self.logp[a][b][_EDGE] if b != _EDGE else 0.0), t) for (a, b), (s, t) in states.items()), default=(0.0, ""))[1].strip()


def _lattice(span: str, letter_at: int = -1) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, its readings and their costs under the channel."""
    out: list[list[tuple[str, float]]] = []
    i, n = 0, len(span)
    while i < n:
        ch = span[i]
        j = i
        while j < n and span[j] == ch:
            j += 1
        run = j - i
        if ch in READINGS:
            letters = READINGS[ch]
            options = [(x * k, 0.3 * len(letters) + (0.0 if k == run else 0.5 if run > 2 else 2.5)) for x in letters for k in {1, min(run, 2)}]
            if i == letter_at:
                options = [(x * min(run, 2), 0.3 * len(letters)) for x in letters]
            elif ch in _SEPARATOR or not ch.isdigit():
                options += [("", 2.0), (" ", 3.0)]
            else:
                options.append(("", 12.0))
        elif ch.isalpha():
            options = [(ch * k, 0.0 if k == run else 0.5 if run > 2 else 2.5) for k in {1, min(run, 2)}]
        elif ch in _SEPARATOR:
            options = [("", 0.1), (" ", 2.5)]
        else:
            options = [(" ", 0.5), ("", 3.0)]
        out.append(options)
        i = j
    return out


def _halved(word: str) -> list[str]:
    """The word with one of its doubled letters said once, for each of them."""
    return [word[: m.start()] + word[m.start() + 1 :] for m in _TWICE.finditer(word)]


def cell_of(word: str) -> int:
    """A word's cell in the table of weights."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)


class Reader:
    """Distinct restored words of a text."""

    def __init__(self, counts: np.ndarray):
        self.model = CharModel(counts)
        self.memory: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def _word(self, token: str) -> tuple[str, ...]:
        """Readings of a token. Of weak signs and of signs at its end, both what stands and what it may hide."""
        bare, signed = _EDGES.sub("", token), _SIGNED.sub("", token)
        if not any(c.isalpha() for c in bare):
            return tuple(x for x in re.split(r"[\W_]+", bare) if x)
        if _DISGUISED.search(bare):
            out = self.model.restore(bare).split()
        else:
            out = [bare] if bare.isalpha() else [x for x in re.split(r"[\W_]+", bare) if x]
            if _PERHAPS.search(bare):
                joined = "".join(out)
                out += [joined, *_halved(joined), *self.model.restore(bare).split()]
        if len(signed) > len(bare):
            sign = next(i for i in range(len(bare), len(signed)) if signed[i] in READINGS)
            for word in self.model.restore(signed, sign).split():
                out += [word, *_halved(word)]
        return tuple(dict.fromkeys(out))

    def _cells(self, token: str) -> tuple[int, ...]:
        bare = token.strip(_MARKS)
        if bare.isalpha():  # a plain word reads as itself, one with a single doubled letter also without it
            twice = _TWICE.search(bare)
            if not twice:
                return (cell_of(bare),)
            at = twice.end()
            if bare[at : at + 1] != twice[1] and not _TWICE.search(bare, at):
                return cell_of(bare), cell_of(bare[: at - 1] + bare[at:])
        return tuple(map(cell_of, self._word(token)))

    def cells(self, text: str) -> set[int]:
        """Cells of the distinct restored words of a text."""
        low = text.lower()
        memory, before = self.memory, self.before
        out: set[int] = set()
        for token in set(low.split()):
            got = memory.get(token)
            if got is None:
                got = memory[token] = before.get(token) or self._cells(token)
            out.update(got)
        if len(memory) > MEMORY_WORDS:  # words met since stay one more turn
            self.memory, self.before = {}, memory
        for span in _APART.findall(low):
            out.update(cell_of(w) for w in self.model.restore(" ".join(span.split())).split())
        return out

    def words(self, text: str) -> set[str]:
        """The words themselves, for looking at single texts."""
        low = text.lower()
        spans = [w for span in _APART.findall(low) for w in self.model.restore(" ".join(span.split())).split()]
        return {w for token in low.split() for w in self._word(token)} | set(spans)


def _reader(counts) -> Reader:
    return C.kept(("reader", zlib.crc32(counts.value.tobytes())), lambda: Reader(counts.value))


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): distinct texts of a bounded sample of labelled rows outside the held-out fold."""
    train = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    sample = train.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    return rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _learn(spark, training: DataFrame, counts) -> tuple[np.ndarray | None, float, float]:
    """(weights by cell, slope, offset) of the score; no weights without labels of both kinds."""

    def seen(batches):
        n = np.zeros((2, 1 << HASH_BITS), np.int64)
        for b in batches:
            reader = _reader(counts)
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                cells = reader.cells(text.as_py())
                n[y, np.fromiter(cells, np.int64, len(cells))] += 1
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[1, some]), pa.array(n[0, some])], ["cell", "n1", "n0"])

    size = training.groupBy().agg(F.sum(F.col("toxic").cast("long")).alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = size.n1 or 0, size.n - (size.n1 or 0)
    if not n1 or not n0:
        return None, 0.0, -math.inf
    table = training.mapInArrow(seen, "cell int, n1 long, n0 long").groupBy("cell").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    met = table.toArrow()  # 2**HASH_BITS rows at most
    weights = np.zeros(1 << HASH_BITS, np.float32)
    weights[met.column("cell").to_numpy()] = _weight(met.column("n1").to_numpy(), met.column("n0").to_numpy(), n1, n0)
    sums = _summed(training.select(F.col("toxic").cast("long").alias("key"), "text"), "long", counts, spark.sparkContext.broadcast(weights))
    bins = [(r.s, r.key, r["count"]) for r in sums.select(F.round("s", 1).alias("s"), "key").groupBy("s", "key").count().collect()]
    return weights, *_calibrate(bins)


def _weight(k1: np.ndarray, k0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log odds of a word in k1 of n1 toxic and k0 of n0 other texts, drawn towards 0 by what its standard error leaves open."""
    p1, p0 = (k1 + SMOOTHING) / (n1 + 2 * SMOOTHING), (k0 + SMOOTHING) / (n0 + 2 * SMOOTHING)
    odds = np.log(p1) - np.log(p0)
    share = (k1 + k0 + SMOOTHING) / (n1 + n0 + 2 * SMOOTHING)
    z2 = (p1 - p0) ** 2 / (share * (1 - share) * (1 / n1 + 1 / n0))
    return odds * (z2 / (z2 + DOUBT**2)) ** 4


def _calibrate(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (sum, label, count), by Newton steps with a small penalty."""
    x, y, n = (np.array(v, float) for v in zip(*bins, strict=True))
    a, b = 0.1, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(n * (p - y) * x).sum() + 1e-3 * a, (n * (p - y)).sum() + 1e-3 * b])
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = max(a - step[0], 1e-6), b - step[1]
    return float(a), float(b)


def _summed(keyed: DataFrame, kind: str, counts, weights) -> DataFrame:
    """(key, s): the sum of the weights of a text's distinct words. keyed: a key and a text, or a struct with the text inside."""
    inside = len(keyed.columns) == 1

    def run(batches):
        w = weights.value
        for b in batches:
            reader = _reader(counts)
            texts = b.column(0).field("text") if inside else b.column(1)
            s = []
            for t in texts:
                cells = reader.cells(t.as_py() or "")
                s.append(float(w[np.fromiter(cells, np.int64, len(cells))].sum(dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["key", "s"])

    C.bounded_batches(keyed.sparkSession)
    return keyed.mapInArrow(run, f"key {kind}, s double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(row struct of the key columns, score) of every row of docs; all columns of docs are keys where none are named."""
    spark = docs.sparkSession
    counts = np.zeros(_N**3, np.int64)
    for r in trigram_counts(docs).collect():  # 28**3 rows at most
        counts[r.cell] = r.n
    counts = spark.sparkContext.broadcast(counts)
    weights, slope, offset = _learn(spark, C.cut(_training(docs, labels)), counts)
    if weights is None:
        return docs.select(F.struct(*[F.col(f"`{c}`") for c in keys or docs.columns]).alias("row"), F.lit(0.0).alias("score"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keys or docs.columns]).alias("key"), *(["text"] if keys else []))
    s = _summed(keyed, keyed.schema["key"].dataType.simpleString(), counts, spark.sparkContext.broadcast(weights))
    return s.select(F.col("key").alias("row"), (1 / (1 + F.exp(-(F.col("s") * slope + offset)))).alias("score"))


def op8_noisy_channel_toxicity(spark, sf_dir: str) -> DataFrame:
    s = toxicity_scores(C.documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
    held_out = F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0
    return s.select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_noisy_channel_toxicity": op8_noisy_channel_toxicity}
ORACLE = {}
