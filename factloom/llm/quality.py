"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark every word that lies inside an n-gram found more than once in its
document; the covered characters over all word characters, with the characters of repeated lines, decide.

Defined cases: null or blank text has zero counts and fails the base rule (fewer than 50 words); rows are judged
alone, so repeated rows get equal verdicts; other columns, whatever their names, are ignored unless named as the key.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 50
MAX_REPEAT_WORDS_PCT = 50
#: Most characters inside repeated n-grams of so many words, as a share of the word characters.
MAX_COVERAGE = {5: 0.30, 7: 0.25, 10: 0.20}
#: Most characters in lines equal to an earlier line, as a share of the word characters.
MAX_LINE_COVERAGE = 0.30

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False  # bytes that continue a code point
_WORD = re.compile(rb"[^\x20\x09-\x0D]")

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_{k}gram_chars long" for k in MAX_COVERAGE)


def _covered(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """For each word, whether a window of k words that its document holds twice or more covers it."""
    starts, doc = C.per_document_windows(first, k)
    out = np.zeros(len(words) + 1, np.int32)
    if len(starts):
        key = C.windows_hash(words, k)[starts] ^ C.mix(doc.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        ranked = key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        again = starts[order[same[1:] | same[:-1]]]
        np.add.at(out, again, 1)
        np.add.at(out, again + k, -1)
    return np.cumsum(out[:-1]) > 0


def _lines(text: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, their word characters)."""
    parts = text.split(b"\n")
    if len(parts) < 2:
        return 0, 0
    seen: set[bytes] = set()
    n = chars = 0
    for x in parts:
        if x in seen:
            if _WORD.search(x):
                n += 1
                chars += len(b"".join(x.split()).decode("utf-8", "replace"))
        else:
            seen.add(x)
    return n, chars


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The columns of FIELDS for a batch of texts."""
    raw, off = C.utf8(texts)
    out = [np.zeros(len(off) - 1, np.int64) for _ in range(6 + len(MAX_COVERAGE))]
    for i, j, part, at in C.pieces(raw, off):
        w = C.Words(part, at)
        n_words = w.counts()
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
        heads = np.concatenate([[0], np.cumsum(_HEAD[part])])
        chars = heads[w.end] - heads[w.begin]
        per_doc = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[w.first])
        hashes = w.hashes()
        lines = np.array([_lines(part[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64).reshape(-1, 2)
        values = [n_words, per_doc(chars), sums(_SYMBOLS[part]), lines[:, 0], per_doc(_covered(hashes, w.first, 3)), lines[:, 1]]
        values += [per_doc(np.where(_covered(hashes, w.first, k), chars, 0)) for k in MAX_COVERAGE]
        for column, v in zip(out, values, strict=True):
            column[i:j] = v
    return out


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the measures, base_failed and kept."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, measure(b.column(1)))], ["id", *names])

    names = [x.split()[0] for x in FIELDS.split(", ")]
    key = docs.schema[id_col].dataType.simpleString()
    m = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {key}, {FIELDS}")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_WORDS_PCT)
    ok = F.col("dup_line_chars") <= F.col("word_chars") * MAX_LINE_COVERAGE
    for k, most in MAX_COVERAGE.items():
        ok = ok & (F.col(f"dup_{k}gram_chars") <= F.col("word_chars") * most)
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & ok).withColumnRenamed("id", id_col)


def op5_repetition_coverage(spark, sf_dir: str) -> DataFrame:
    return repetition_coverage(C.documents(spark, sf_dir))


_KS = [3, *MAX_COVERAGE]
_CHARS = {k: f"coalesce(any_value(x.chars) FILTER (WHERE x.k = {k}), 0)::BIGINT" for k in MAX_COVERAGE}
ORACLE = {
    "op5_repetition_coverage": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda v: v <> '') AS w FROM d),
s AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest({_KS}) AS k) WHERE len(w) >= k)),
m AS (SELECT r, k, g FROM s GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT DISTINCT r, k, unnest(range(i, i + k)) AS p FROM s SEMI JOIN m USING (r, k, g)),
x AS (SELECT c.r, c.k, count(*) AS n, sum(length(w.w[p])) AS chars FROM c JOIN w USING (r) GROUP BY 1, 2),
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS rn FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
u AS (SELECT r, count(*) AS n, sum(length(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))) AS chars FROM l WHERE rn > 1 AND regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY 1),
a AS (SELECT w.r, any_value(w.doc_id) AS doc_id, any_value(len(w.w))::BIGINT AS n_words, coalesce(any_value(length(array_to_string(w.w, ''))), 0)::BIGINT AS word_chars,
  any_value(length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(any_value(u.n), 0)::BIGINT AS n_dup_lines, coalesce(any_value(x.n) FILTER (WHERE x.k = 3), 0)::BIGINT AS n_repeat_words,
  coalesce(any_value(u.chars), 0)::BIGINT AS dup_line_chars, {", ".join(f"{v} AS dup_{k}gram_chars" for k, v in _CHARS.items())}
  FROM w LEFT JOIN x USING (r) LEFT JOIN u USING (r) GROUP BY w.r)
SELECT * EXCLUDE (r), n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_WORDS_PCT} AS base_failed,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_WORDS_PCT}) AND dup_line_chars <= word_chars * {MAX_LINE_COVERAGE} AND {" AND ".join(f"dup_{k}gram_chars <= word_chars * {v}" for k, v in MAX_COVERAGE.items())} AS kept
FROM a"""
}
QUERIES = {"op5_repetition_coverage": op5_repetition_coverage}
