"""Line dedup over range-partitioned hashes.

Each line is a hash of 128 bits with its document and position. Hashes are
range-partitioned and sorted by hash, document and position; one pass streams the
first occurrence of each. The result is a compressed keep bitmap per document, no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm import kernels
from trigrove.llm.common import col, map_rows, partitions


def encode_runs(keep: np.ndarray) -> str:
    """A keep bitmap as alternating run lengths, kept lines first: [1,1,0,1] is "2,1,1"."""
    if not len(keep):
        return ""
    edge = np.flatnonzero(np.diff(keep.astype(np.int8))) + 1
    lengths = np.diff(np.concatenate(([0], edge, [len(keep)]))).tolist()
    return ",".join(map(str, lengths if keep[0] else [0, *lengths]))


def decode_runs(text: str) -> np.ndarray:
    if not text:
        return np.zeros(0, bool)
    lengths = np.array([int(x) for x in text.split(",")])
    return np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)


@lru_cache(maxsize=2)
def _values(seed: int) -> np.ndarray:
    return kernels.mix64(np.arange(1, 0x20001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _sums(cps: np.ndarray, seed: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For each range the sum of its code points' values times rising powers."""
    values = _values(seed)
    p, q = kernels._powers(len(cps) + 1)
    v = values[cps] if not len(cps) or int(cps.max()) < len(values) else np.where(cps < len(values), values[np.minimum(cps, len(values) - 1)], kernels.mix64(cps.astype(np.uint64) + np.uint64(seed)))
    total = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(v * p[: len(cps)], out=total[1:])
    return (total[e] - total[s]) * q[s]


def _lines_of_long(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sums and the length of each line of a text that is read in pieces; a line that goes on in the next piece is put together."""
    sums: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    open_sums, open_size = np.zeros(2, np.uint64), 0
    mask = (1 << 64) - 1
    for lo in range(0, len(text), kernels.SLICE_CHARS):
        cps = np.frombuffer(text[lo : lo + kernels.SLICE_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        e = np.concatenate((np.flatnonzero(cps == 10), [len(cps)]))
        s = np.concatenate(([0], e[:-1] + 1))
        x = np.stack([_sums(cps, 0, s, e), _sums(cps, 1, s, e)], axis=1)
        n = e - s
        power = pow(kernels._BASE & mask, open_size, 1 << 64)
        x[0] = [(int(o) + int(v) * power) & mask for o, v in zip(open_sums, x[0])]
        n[0] += open_size
        open_sums, open_size = x[-1].copy(), int(n[-1])
        sums.append(x[:-1])
        sizes.append(n[:-1])
    sums.append(open_sums[None])
    sizes.append(np.array([open_size]))
    x = np.concatenate(sums)
    return x[:, 0], x[:, 1], np.concatenate(sizes)


def _line_hashes(texts: list[str | None], min_chars: int, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """Both hashes, row and position of each line that may be a duplicate, and the number of lines per row."""
    hs, gs, rs, ps, counts = [], [], [], [], np.zeros(len(texts), np.int64)
    for lo, hi in kernels.slices(texts):
        text = texts[lo]
        if hi == lo + 1 and text and len(text) > kernels.SLICE_CHARS:
            one, two, size = _lines_of_long(text)
            row, pos = np.zeros(len(size), np.int64), np.arange(len(size))
            counts[lo] = len(size)
            long = size >= max(1, min_chars)
        else:
            cps, begins = kernels.code_points(texts[lo:hi])
            e = np.flatnonzero(cps == 10)  # each text is followed by one, so every line has its end
            s = np.concatenate(([0], e[:-1] + 1))
            size = e - s
            row = np.searchsorted(begins, s, side="right") - 1
            counts[lo:hi] = np.bincount(row, minlength=hi - lo)
            pos = np.arange(len(s)) - np.searchsorted(s, begins)[row]
            long = size >= max(1, min_chars)
            if hashed:
                one, two = _sums(cps, 0, s, e), _sums(cps, 1, s, e)
        if hashed:
            hs.append(kernels.mix64(one + size.astype(np.uint64))[long])
            gs.append(kernels.mix64(two ^ size.astype(np.uint64))[long])
        rs.append(row[long] + lo)
        ps.append(pos[long])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(hs, np.uint64), cat(gs, np.uint64), cat(rs, np.int64), cat(ps, np.int64), counts


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_kept, keep_runs (decode_runs gives the bitmap).

    Lines are what line feeds separate. The first occurrence of a line, by doc_id
    and then position, is kept, later ones are not; lines of under ``min_chars``
    characters (empty ones at least) are always kept. Lines are told apart by 128 bits. A null text has no lines, an
    empty one has one. Rows with a null doc_id take no part. Rows with the same
    doc_id are one document: its lines count once per position, and n_lines is
    that of the longest. Other columns are not read; an empty table gives no rows.
    """
    d = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).where("doc_id IS NOT NULL")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            h, g, row, pos, counts = _line_hashes(b.column(1).to_pylist(), min_chars)
            doc = ids[row] if len(row) else np.zeros(0, np.int64)
            # within a batch only the first of equal lines can be the first of all: the others go no further
            order = np.lexsort((pos, doc, g, h))
            first = np.ones(len(order), bool)
            first[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
            k = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(h[k].view(np.int64)), pa.array(g[k].view(np.int64)), pa.array(doc[k]), pa.array(pos[k].astype(np.int32))], names=["h", "g", "doc_id", "pos"])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for b in batches:
            h, g = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            new[0] = (h[0], g[0]) != last
            last = (h[-1], g[-1])
            yield pa.RecordBatch.from_arrays([b.column(2).filter(pa.array(new)), b.column(3).filter(pa.array(new))], names=["doc_id", "pos"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a document's number of lines, and which of them are long enough to be judged
        for b in batches:
            texts = b.column(1).to_pylist()
            _, _, row, pos, counts = _line_hashes(texts, min_chars, hashed=False)
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            n = np.where([t is None for t in texts], 0, counts).astype(np.int32)
            packed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(pos.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), packed], names=["doc_id", "n_lines", "judged"])

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n_lines, judged, kept = (b.column(i).to_pylist() for i in range(4))
            n_kept, text = [], []
            for n, j, k in zip(n_lines, judged, kept):
                keep = np.ones(n, bool)
                if j:
                    keep[np.array(j)] = False
                if k:
                    keep[np.array(k)] = True
                n_kept.append(int(keep.sum()))
                text.append(encode_runs(keep))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_kept, pa.int32()), pa.array(text, pa.string())], names=["doc_id", "n_lines", "n_kept", "keep_runs"])

    n = partitions(d)
    # hashes are uniform, so n equal ranges of them need no sampling, which would read all documents once more
    part = F.shiftright((F.shiftright("h", 32) + F.lit(1 << 31)) * F.lit(n).cast("long"), 32).cast("int")
    lines = d.mapInArrow(hashes, "h long, g long, doc_id long, pos int").repartitionById(n, part).sortWithinPartitions("h", "g", "doc_id", "pos")
    kept = lines.mapInArrow(firsts, "doc_id long, pos int").groupBy("doc_id").agg(F.collect_list("pos").alias("kept"))
    size = d.mapInArrow(sizes, "doc_id long, n_lines int, judged array<int>").groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("judged"))).alias("judged"))
    return size.join(kept, "doc_id", "left").select("doc_id", "n_lines", "judged", "kept").mapInArrow(bitmaps, "doc_id long, n_lines int, n_kept int, keep_runs string")


def drop_repeated_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` without the lines that ``bitmaps`` drops; columns as they are.

    A document goes when lines were dropped and only blank ones are left, so copies of long lines go
    and short lines that nothing else holds stay. Without a bitmap (null ids) a row stays as it is. The column of
    integers ``chars_col``, if one is named, follows the new text.
    """
    names = docs.columns
    at, chars = names.index(text_col), names.index(chars_col) if chars_col is not None else -1
    some = bitmaps.where("n_kept < n_lines").select(F.col("doc_id").alias("__keep_id"), F.col("keep_runs").alias("__keep_runs"))
    joined = docs.join(some.hint("shuffle_hash"), col(id_col).cast("long") == F.col("__keep_id"), "left").select(*[docs[f"`{c}`"] for c in names], "__keep_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keeps = b.column(at).to_pylist(), b.column(len(names)).to_pylist()
            stay = np.ones(len(texts), bool)
            for i, (t, k) in enumerate(zip(texts, keeps)):
                if k is None or t is None:
                    continue
                keep = decode_runs(k)
                left = [x for j, x in enumerate(t.split("\n")) if j >= len(keep) or keep[j]]
                stay[i] = any(x.strip() for x in left)
                texts[i] = "\n".join(left)
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, cols[at].type)
            if chars >= 0:
                old = b.column(chars).to_pylist()
                cols[chars] = pa.array([o if k is None or t is None else len(t) for t, k, o in zip(texts, keeps, old)], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(stay))

    return map_rows(joined, run, docs.schema)
