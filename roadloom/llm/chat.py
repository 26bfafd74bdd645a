"""Chat formatting by columnar byte assembly, and reading it back.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. Control strings inside roles and texts (the
template's own and those of other common templates) get a backslash after their first character, and one more if they
have some there already, so that no text can pretend to be a turn and every text can be had back.

The bytes of a batch of conversations are assembled at once: lengths of all segments, their running sums, and from these
the place of every byte of the output in a buffer of constants, roles and texts; one take fills the Arrow buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.textops import flat, gather

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# What follows the first character of a control string.
AFTER_ANGLE = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>"
AFTER_BRACKET = r"/?INST\]"
ESCAPES = ((rf"(<\\*)({AFTER_ANGLE})", "<"), (rf"(\[\\*)({AFTER_BRACKET})", "["))
_UNESCAPE = re.compile(rf"(<\\*)\\({AFTER_ANGLE})|(\[\\*)\\({AFTER_BRACKET})")
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END), re.S)
TURN_SCHEMA = "conv_id bigint, formatted string, n_turns bigint, loss_spans array<struct<first: bigint, last: bigint>>"


def escape(column: pa.Array) -> pa.Array:
    column = pc.fill_null(column, "")
    for pattern, first in ESCAPES:
        if pc.any(pc.match_substring(column, first)).as_py():
            column = pc.replace_substring_regex(column, pattern, r"\1\\\2")
    return column


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), text)


def assemble(roles: pa.Array, texts: pa.Array, turns: np.ndarray, trained: str = "assistant") -> tuple[pa.Array, pa.Array]:
    """The formatted conversations of some rows in order, and the spans (code points) that the loss covers.

    turns: how many rows each conversation has.
    """
    role_raw, role_at = flat(escape(roles))
    text_raw, text_at = flat(escape(texts))
    fixed = [s.encode() for s in (START, SEP, END)]
    source = np.frombuffer(b"".join([*fixed, role_raw, text_raw]), np.uint8)
    base = np.cumsum([0, *map(len, fixed), len(role_raw)])
    n = len(role_at) - 1
    starts, lengths = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, c in ((0, 0), (2, 1), (4, 2)):
        starts[:, k], lengths[:, k] = base[c], len(fixed[c])
    starts[:, 1], lengths[:, 1] = base[3] + role_at[:-1], np.diff(role_at)
    starts[:, 3], lengths[:, 3] = base[4] + text_at[:-1], np.diff(text_at)
    out = np.empty(int(lengths.sum()), np.uint8)
    np.take(source, gather(starts.ravel(), lengths.ravel()), out=out)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    row_end = np.concatenate(([0], ends[:, 4]))
    at = row_end[np.concatenate(([0], np.cumsum(turns)))]
    formatted = pa.LargeStringArray.from_buffers(len(turns), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out))
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    learn = np.asarray(pc.fill_null(pc.equal(roles, trained), False)).astype(bool)
    owner = np.repeat(np.arange(len(turns)), turns)
    zero = points[at[:-1]][owner]
    first, last = points[ends[:, 2]] - zero, points[ends[:, 3]] - zero
    count = np.bincount(owner[learn], minlength=len(turns))
    spans = pa.StructArray.from_arrays([pa.array(first[learn]), pa.array(last[learn])], ["first", "last"])
    return formatted, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), spans)


def format_conversations(turns: DataFrame, batch_bytes: int = 2 << 20) -> DataFrame:
    """(conv_id, formatted, n_turns, loss_spans) of (conv_id, turn, role, text).

    Turns are ordered by (turn, role, text), null first. Null roles and texts are empty; rows without a conv_id are one
    conversation; repeated rows are turns each. A conversation is one row of the result, so a task holds one at a time
    besides a batch of short ones. An empty table gives no conversations.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            ids = t.column(0).combine_chunks()
            new = np.flatnonzero(changes(ids))
            turns = np.diff(np.append(new, len(ids)))
            formatted, spans = assemble(t.column(1).combine_chunks(), t.column(2).combine_chunks(), turns)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(new)), formatted.cast(pa.string()), pa.array(turns.astype(np.int64)), spans], ["conv_id", "formatted", "n_turns", "loss_spans"])

        for b in batches:
            if not b.num_rows:
                continue
            new = changes(b.column(0))
            new[0] = not held or not held[-1].column(0)[-1].equals(b.column(0)[0])
            if size >= batch_bytes and new.any():  # the last conversation may go on
                cut = int(np.flatnonzero(new)[-1])
                if cut or held:
                    yield done(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held, size, b = [], 0, b.slice(cut)
            held.append(b)
            size += b.nbytes
        if held:
            yield done(pa.Table.from_batches(held))

    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*order).repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "role", "text").mapInArrow(work, TURN_SCHEMA)


def changes(ids: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it."""
    null = np.asarray(ids.is_null())
    value = np.asarray(pc.fill_null(ids, 0))
    out = np.ones(len(value), bool)
    out[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return out


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations say, from their output alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                learnt = "".join(unescape(text[s["first"] : s["last"]]) for s in spans)
                rows.append({
                    "conv_id": conv, "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    "loss_chars": len(learnt), "loss_sha256": hashlib.sha256(learnt.encode()).hexdigest(), "formatted_chars": len(text),
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(work, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations and one of id -7, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(role = 'assistant', false) AS learn FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', false
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', true
), e AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '(<\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g'))
    + length(regexp_replace(regexp_replace(role, '(<\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g')) + 33 AS chars
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (learn), '') AS learnt, sum(chars)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM g
"""
