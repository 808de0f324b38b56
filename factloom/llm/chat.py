"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that reply is
trainable. A turn is written ``[INST]role[/INST]text</s>``; inside roles and texts a control string gets one more
backslash behind its first character, so that reading takes one away and gives the exact text.

A conversation that ends on other turns, or has no assistant turn, gets one last example without a trainable part, so
the output holds every turn. Rows of a conversation are taken in the order (turn, role, text); a null role or text is
empty, a null conv_id is a conversation of its own, repeated rows are repeated turns. Examples are streamed turn by turn
from sorted partitions: a task holds one conversation's text so far, never all its examples. The output itself is
quadratic in the turns of a conversation, as each example repeats its context.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
_ESCAPE = re.compile(r"([\[<])(\\*)(/?INST\]|/?s>)")
_UNESCAPE = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?s>)")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
#: An output batch is handed on at about so many characters.
BATCH_CHARS = 1 << 22

EXAMPLE = "conv_id long, example long, n_turns long, formatted string, loss_start long, loss_end long, is_last boolean"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _with_last(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The rows, each with whether it is the last of its conversation."""
    before = None
    for row in rows:
        if before is not None:
            yield *before, before[0] != row[0]
        before = row
    if before is not None:
        yield *before, True


def _expand(rows: Iterator[tuple]) -> Iterator[tuple]:
    parts: list[str] = []
    n = k = length = 0
    pending = False
    for conv, role, text, last in _with_last(rows):
        head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text) + END
        parts.append(head + body)
        n += 1
        pending = role != "assistant"
        if not pending:
            begin = length + len(head)
            parts = ["".join(parts)]
            yield conv, k, n, parts[0], begin, begin + len(body) - len(END), last
            k += 1
        length += len(head) + len(body)
        if last:
            if pending:
                yield conv, k, n, "".join(parts), None, None, True
            parts, n, k, length = [], 0, 0, 0


def expand(conversations: DataFrame) -> DataFrame:
    """Columns of EXAMPLE for every conversation; other columns are left behind."""

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

        out: list[tuple] = []
        held = 0
        for e in _expand(rows()):
            out.append(e)
            held += len(e[3])
            if held > BATCH_CHARS:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    order = turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return order.select("conv_id", "role", "text").mapInArrow(run, EXAMPLE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in EXAMPLE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_back(examples: DataFrame, regroup: bool = False) -> DataFrame:
    """Per conversation, from its examples alone: turns and trainable texts, with their digests.

    Examples are taken in the order of their numbers. Those of a conversation must be in one partition, as expand() leaves them;
    regroup brings them together where they may have been dealt out since.
    """
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

    def run(batches):
        loss, chars, total, n = hashlib.sha256(), 0, 0, 0
        for b in batches:
            out = []
            for conv, formatted, begin, end, last in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                total += len(formatted)
                n += 1
                if begin is not None:
                    reply = unescape(formatted[begin:end])
                    chars += len(reply)
                    loss.update(reply.encode())
                if last:
                    turns = parse(formatted)
                    whole = hashlib.sha256()
                    for role, text in turns:
                        whole.update(f"{role}\n{text}\n".encode())
                    out.append((conv, len(turns), whole.hexdigest(), chars, loss.hexdigest(), total, n))
                    loss, chars, total, n = hashlib.sha256(), 0, 0, 0
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in fields.split(", ")])

    together = examples.repartition("conv_id") if regroup else examples
    ordered = together.select("conv_id", "formatted", "loss_start", "loss_end", "is_last", "example").sortWithinPartitions("conv_id", "example")
    return ordered.drop("example").mapInArrow(run, fields)


def op4_prefix_target(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(expand(conversations.unionByName(probe)))


_TURN_SQL = r"""regexp_replace({0}, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g')"""
ORACLE = {
    "op4_prefix_target": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, length('[INST]' || {_TURN_SQL.format("role")} || '[/INST]' || {_TURN_SQL.format("text")} || '</s>') AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS turns FROM t),
p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS pre FROM s)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (coalesce(sum(pre) FILTER (WHERE role = 'assistant' OR k = turns), 0))::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant' OR k = turns) AS n_examples
FROM p GROUP BY conv_id"""
}
QUERIES = {"op4_prefix_target": op4_prefix_target}
