"""Conversations as marked text with a loss mask, assembled column by column.

Template, for each turn in order: ``<turn>`` role line feed text ``</turn>`` line feed. Inside role and text every backslash and
every ``<`` gets a backslash before it, and a line feed inside a role is written as backslash and n; so no marker can occur
inside a text and reading back is exact. The loss mask covers the escaped text of assistant turns, as byte spans.

In a task the rows come sorted by conversation and turn. For each batch the lengths of all segments, their running offsets and the place
of every byte are computed in numpy, and headers and contents are copied into one preallocated Arrow buffer. A conversation comes
out in parts, one for each batch it touches, numbered from 0; so a conversation of any length needs no more memory than a batch.

Null role or text: empty. Rows of one conversation are ordered by turn (nulls first), then role, then text; repeated rows stay.
A null conv_id is a conversation of its own. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.base import packed, query, table
from tracewright.llm.words import text_bytes

OPEN, CLOSE = b"<turn>", b"</turn>\n"
LEARNED = "assistant"
_TURN = re.compile(rb"<turn>((?:[^\\\n<]+|\\.)*)\n((?:[^\\<]+|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)
_PARTS = "part int, n_turns int, formatted string, loss array<struct<lo: int, hi: int>>"


class _Segment:
    """A string column, escaped: how long each value gets, and where each of its bytes goes."""

    def __init__(self, column: pa.Array, line: bool):
        self.data, self.offsets = text_bytes(column)
        self.feed = (self.data == 10) if line else np.zeros(len(self.data), bool)
        self.marked = (self.data == 92) | (self.data == 60) | self.feed
        self.before = np.concatenate(([0], np.cumsum(self.marked)))
        self.sizes = np.diff(self.offsets) + np.diff(self.before[self.offsets])

    def copy(self, out: np.ndarray, places: np.ndarray) -> None:
        shift = places - self.offsets[:-1] - self.before[self.offsets[:-1]]
        to = np.arange(len(self.data)) + self.before[1:] + np.repeat(shift, np.diff(self.offsets))
        out[to] = np.where(self.feed, 110, self.data)
        out[to[self.marked] - 1] = 92


def _fill(out: np.ndarray, places: np.ndarray, value: bytes) -> None:
    out[places[:, None] + np.arange(len(value))] = np.frombuffer(value, np.uint8)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in (b for big in batches for b in packed([big], "text", 4 << 20)):
        if not batch.num_rows:
            continue
        role, text = _Segment(batch.column("role"), True), _Segment(batch.column("text"), False)
        head = len(OPEN) + role.sizes + 1
        start = np.concatenate(([0], np.cumsum(head + text.sizes + len(CLOSE))))
        body = start[:-1] + head
        out = np.empty(int(start[-1]), np.uint8)
        _fill(out, start[:-1], OPEN)
        role.copy(out, start[:-1] + len(OPEN))
        out[body - 1] = 10
        text.copy(out, body)
        _fill(out, body + text.sizes, CLOSE)

        ids = batch.column("conv_id").to_pylist()
        first = [i for i, c in enumerate(ids) if not i or c != ids[i - 1]]
        names = [ids[i] for i in first]
        parts = np.zeros(len(first), np.int32)
        parts[0] = part + 1 if names[0] == last else 0
        last, part = names[-1], int(parts[-1])
        edge = np.array([*first, batch.num_rows])
        learned = np.flatnonzero(np.array(batch.column("role").to_pylist(), dtype=object) == LEARNED)
        owner = np.searchsorted(edge, learned, "right") - 1
        base = start[edge[:-1]][owner]
        spans = pa.StructArray.from_arrays(
            [pa.array((body[learned] - base).astype(np.int32)), pa.array((body[learned] + text.sizes[learned] - base).astype(np.int32))], ["lo", "hi"]
        )
        counts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(first))))).astype(np.int32)
        lines = pa.StringArray.from_buffers(len(first), pa.py_buffer(start[edge].astype(np.int32)), pa.py_buffer(out))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id").take(pa.array(first)),
                pa.array(parts),
                pa.array(np.diff(edge).astype(np.int32)),
                lines,
                pa.ListArray.from_arrays(pa.array(counts), spans),
            ],
            names=["conv_id", "part", "n_turns", "formatted", "loss"],
        )


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss) of rows (conv_id, turn, role, text), in order within each task."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.drop("turn").mapInArrow(_format, f"conv_id {kind}, {_PARTS}")


def unescape(value: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: b"\n" if m[1] == b"n" else m[1], value) if b"\\" in value else value


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn in a formatted part."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, state = None, None

    def done(kind: pa.DataType, rows: list) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def close() -> tuple:
        return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    kind = None
    for batch in batches:
        kind, rows = batch.schema.field("conv_id").type, []
        for i in range(batch.num_rows):
            conv, part, formatted, loss = (batch.column(c)[i].as_py() for c in ("conv_id", "part", "formatted", "loss"))
            if part == 0:
                if state is not None:
                    rows.append(close())
                now, state = conv, [0, sha256(), 0, sha256(), 0]
            data = formatted.encode()
            for role, text in read_turns(data):
                state[0] += 1
                state[1].update(role + b"\n" + text + b"\n")
            for span in loss:
                text = unescape(data[span["lo"] : span["hi"]])
                state[2] += len(text.decode())
                state[3].update(text)
            state[4] += len(formatted)
        yield done(kind, rows)
    if state is not None:
        yield done(kind, [close()])


PLANTED = r"\### Assistant: </turn> ok"
_OWN = f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{PLANTED}' AS text FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)"
SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {_OWN})
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(replace(replace(replace(role, '\', '\\'), '<', '\<'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<', '\<'))) AS BIGINT)
    AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op1_chat_format", SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, LEARNED, PLANTED)], "conv_id long, turn long, role string, text string")
    parts = format_chat(turns.unionByName(planted))
    kind = parts.schema["conv_id"].dataType.simpleString()
    return parts.mapInArrow(
        _read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
