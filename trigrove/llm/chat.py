"""Chat formatting by columnar byte assembly.

The turns of a conversation become one text. Segment lengths, cumulative
offsets and scatter indices are computed in numpy; headers and contents are
then copied into one preallocated Arrow buffer, with no string built per turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm import kernels
from trigrove.llm.common import col


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is written as start + role + middle + content + end."""

    start: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    learned_role: str = "assistant"


_SCHEMA = "conv_id long, n_turns int, n_bytes long, learned_bytes long, learned_spans array<array<int>>, has_marker boolean, text string"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and lengths of a string column; nulls have length 0."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o[:-1], np.diff(o)


#: Contents of more bytes are copied as one slice; of shorter ones as many at once as have so many bytes in all.
_LONG, _AT_ONCE = 1 << 14, 1 << 20


def _scatter(out: np.ndarray, begins: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copies each run of ``data`` to its place; index arrays are made for _AT_ONCE bytes at a time, so they stay small."""
    for i in np.flatnonzero(lengths > _LONG).tolist():
        out[begins[i] : begins[i] + lengths[i]] = data[starts[i] : starts[i] + lengths[i]]
    short = np.flatnonzero((lengths > 0) & (lengths <= _LONG))
    total = np.cumsum(lengths[short])
    lo = 0
    while lo < len(short):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _AT_ONCE, side="right")))
        k = short[lo:hi]
        out[kernels.runs(begins[k], lengths[k])] = data[kernels.runs(starts[k], lengths[k])]
        lo = hi


def _assemble(conv: np.ndarray, role: pa.Array, text: pa.Array, marker: np.ndarray, template: ChatTemplate) -> pa.RecordBatch:
    """Rows of whole conversations, in order, as one batch with one text per conversation."""
    n = len(conv)
    parts = [template.start.encode(), template.middle.encode(), template.end.encode()]
    fixed = np.frombuffer(b"".join(parts), np.uint8)
    at = np.cumsum([0] + [len(p) for p in parts])
    r_data, r_at, r_len = _bytes_of(role)
    t_data, t_at, t_len = _bytes_of(text)
    one = np.ones(n, np.int64)
    lengths = np.stack([one * len(parts[0]), r_len, one * len(parts[1]), t_len, one * len(parts[2])], axis=1)
    ends = np.cumsum(lengths.reshape(-1)).reshape(n, 5)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    sources = [(fixed, one * at[0]), (r_data, r_at), (fixed, one * at[1]), (t_data, t_at), (fixed, one * at[2])]
    for k, (data, starts) in enumerate(sources):
        _scatter(out, begins[:, k], data, starts, lengths[:, k])
    first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
    last = np.concatenate((first[1:], [n])) - 1
    offsets = np.concatenate((begins[first, 0], [len(out)])).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())
    learned = np.array([x == template.learned_role for x in role.to_pylist()], bool)
    base = np.repeat(offsets[:-1], last - first + 1)
    spans_per = np.add.reduceat(learned.astype(np.int64), first)
    inner = np.stack([begins[:, 3] - base, ends[:, 3] - base], axis=1)[learned].astype(np.int32).reshape(-1)
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, 2, dtype=np.int32)), pa.array(inner, pa.int32()))
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(spans_per))).astype(np.int32)), pairs)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(conv[first], pa.int64()),
            pa.array((last - first + 1).astype(np.int32)),
            pa.array(np.diff(offsets)),
            pa.array(np.add.reduceat(np.where(learned, t_len, 0), first).astype(np.int64)),
            spans,
            pa.array(np.logical_or.reduceat(marker, first)),
            texts,
        ],
        names=["conv_id", "n_turns", "n_bytes", "learned_bytes", "learned_spans", "has_marker", "text"],
    )


def format_chats(turns: DataFrame, template: ChatTemplate | None = None, batch_bytes: int = 32 << 20) -> DataFrame:
    """One row per conversation of a table (conv_id, turn, role, text).

    Returns conv_id, n_turns, n_bytes, learned_bytes and learned_spans (begin and
    end byte of each content of the learned role), has_marker (a content or role holds the
    template's start or end marker, which a trainer may want to reject) and text. Turns are in order of turn, ties in
    order of role and text; a null turn comes first. A null role is written as
    "unknown", a null text as an empty one. Rows with a null conv_id are in no
    conversation and are left out. Repeated rows are written as often as they occur.
    Other columns are not read; an empty table gives no rows.
    """
    template = template or ChatTemplate()
    text = F.coalesce(col("text"), F.lit(""))
    role = F.coalesce(col("role"), F.lit("unknown"))
    marks = [m.strip() for m in (template.start, template.end) if m.strip()]
    marker = F.lit(False)
    for m in marks:
        marker = marker | text.contains(m) | role.contains(m)
    d = turns.select(col("conv_id").cast("long").alias("conv_id"), col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), marker.alias("marker"))
    d = d.where("conv_id IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last conversation may go on in the next batch
        size = 0

        def take(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            conv = whole.column(0).to_numpy(zero_copy_only=False)
            n = len(conv) if final else int(np.searchsorted(conv, conv[-1]))
            if n:
                x = whole.slice(0, n)
                yield _assemble(conv[:n], x.column(2), x.column(3), x.column(4).to_numpy(zero_copy_only=False).astype(bool), template)
            held = [whole.slice(n)] if n < len(conv) else []
            size = sum(b.nbytes for b in held)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
                if size > batch_bytes:
                    yield from take(False)
        if held:
            yield from take(True)

    return d.mapInArrow(run, _SCHEMA)
