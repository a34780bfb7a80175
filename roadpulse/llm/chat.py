"""Conversations as training text with a loss mask, assembled column-wise.

The template opens and closes each turn by role::

    system     <<SYS>> text <</SYS>>          user    <s>[INST] text [/INST]
    assistant  a blank, text, </s>            other   [ROLE]role[TEXT]text[/ROLE]

(no blanks but those of ``TURNS``). Control strings and backslashes inside texts and roles get a
backslash before them, which is taken away again when reading. The mask covers the assistants'
texts.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is cut into
parts and none is gathered in one task. In a batch the lengths of all segments are computed, their
running sums are the offsets in the output, and heads, texts and tails are copied by index arrays
into one buffer that becomes the Arrow column.

Reading back streams a conversation's parts in order and keeps only running digests: a digest of
the whole is sequential by its nature, but needs no memory for it.

Defined results: a null text is empty; a null role is the role of the empty name; a null
conversation is one of its own, null turns first; turns that repeat a number are ordered by role
and text; no rows give no rows. Other columns are ignored.
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

from roadpulse.llm.text import column_bytes

# The control strings of the template.
TURNS = {b"system": (b"<<SYS>>", b"<</SYS>>"), b"user": (b"<s>[INST] ", b" [/INST]"), b"assistant": (b" ", b"</s>")}
OTHER = (b"[ROLE]", b"[TEXT]", b"[/ROLE]")
CONTROL = (b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>", b"[ROLE]", b"[TEXT]", b"[/ROLE]")

_ESCAPED = re.compile(b"|".join(re.escape(c) for c in (b"\\", *sorted(CONTROL, key=len, reverse=True))))
_BACK = re.compile(rb"\\(.)", re.DOTALL)
PARTS = "conv_id long, first_turn long, row long, n_turns long, formatted binary, loss_start array<int>, loss_length array<int>"


def escape(text: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: b"\\" + m[0], text)


def unescape(text: bytes) -> bytes:
    return _BACK.sub(rb"\1", text) if b"\\" in text else text


def _copy(out: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Scatter segments of ``data`` to their offsets in ``out``."""
    whole = np.repeat(np.cumsum(length) - length, length)
    inside = np.arange(length.sum()) - whole
    out[np.repeat(at, length) + inside] = data[np.repeat(start, length) + inside]


def assemble(conv: pa.Array, turn: pa.Array, role: pa.Array, text: pa.Array) -> tuple:
    """Formatted bytes of rows in order: buffer, offsets of rows, and of their texts (start, length)."""
    text = pc.fill_null(text, b"")
    escaped = pc.match_substring_regex(text.cast(pa.large_binary()), r"[\\<\[]").to_numpy(zero_copy_only=False)
    if escaped.any():
        values = text.to_pylist()
        for i in np.flatnonzero(escaped):
            values[i] = escape(values[i])
        text = pa.array(values, pa.binary())
    data, offsets = column_bytes(text)
    roles = pc.fill_null(role, b"").dictionary_encode()
    frames = [TURNS.get(r) or (OTHER[0] + escape(r) + OTHER[1], OTHER[2]) for r in roles.dictionary.to_pylist()]
    kind = roles.indices.to_numpy()
    heads, tails = ([np.frombuffer(f[k], np.uint8) for f in frames] for k in (0, 1))
    head_length, tail_length = (np.array([len(h) for h in hs], np.int64) for hs in (heads, tails))
    length = np.diff(offsets)
    size = head_length[kind] + length + tail_length[kind]
    row = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    at = row + head_length[kind]
    for parts, lengths, place in ((heads, head_length, row), (tails, tail_length, at + length)):
        begin = np.cumsum(lengths) - lengths
        _copy(out, place, np.concatenate(parts), begin[kind], lengths[kind])
    _copy(out, at, data, offsets[:-1], length)
    return out, np.append(row, len(out)), at, length


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, turn, role, text = batch.columns
        out, row, at, length = assemble(conv, turn, role, text)
        ids = conv.to_pylist()
        turns = turn.to_pylist()
        mine = np.array([r == b"assistant" for r in role.to_pylist()])
        cut = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        rows = []
        buffer = out.tobytes()
        for nth, (a, b) in enumerate(zip(cut, cut[1:] + [len(ids)], strict=True)):
            own = np.arange(a, b)[mine[a:b]]
            rows.append((ids[a], turns[a], nth, b - a, buffer[row[a] : row[b]], (at[own] - row[a]).tolist(), length[own].tolist()))
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "first_turn", "row", "n_turns", "formatted", "loss_start", "loss_length"])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted parts of conversations: conv_id, first_turn, row, n_turns, formatted, loss spans in bytes.

    Parts of a conversation are in the order of ``row``; most have one.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).cast("binary").alias("role"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    parts = rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"), "text").select(*order)
    # Ranges are numbered in order, so a part's place in its conversation follows from its partition.
    return parts.mapInArrow(_format, PARTS).withColumn("row", F.monotonically_increasing_id())


def read_turns(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn of formatted bytes."""
    at = 0

    def until(tail: bytes, start: int) -> tuple[bytes, int]:
        end = start
        while True:
            end = text.index(tail, end)
            slashes = end
            while slashes > start and text[slashes - 1] == 92:
                slashes -= 1
            if (end - slashes) % 2 == 0:
                return unescape(text[start:end]), end + len(tail)
            end += 1

    while at < len(text):
        for role, (head, tail) in TURNS.items():
            if text.startswith(head, at):
                content, at = until(tail, at + len(head))
                break
        else:
            role, at = until(OTHER[1], at + len(OTHER[0]))
            content, at = until(OTHER[2], at)
        yield role, content


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    now: list | None = None

    def closed(state: list) -> tuple:
        return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

    for batch in batches:
        rows = []
        for conv, text, starts, lengths in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    rows.append(closed(now))
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, content in read_turns(text):
                now[1] += 1
                now[2].update(role + b"\n" + content + b"\n")
            for start, length in zip(starts, lengths, strict=True):
                loss = unescape(text[start : start + length])
                now[3] += code_points(loss)
                now[4].update(loss)
            now[5] += code_points(text)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(closed(now), kinds, strict=True)], names)


def digests(parts: DataFrame) -> DataFrame:
    """What formatted parts say when read back, per conversation."""
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "row").select("conv_id", "formatted", "loss_start", "loss_length")
    result = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(_read, result)
