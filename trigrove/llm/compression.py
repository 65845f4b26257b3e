"""Quality rules by compression: zstandard ratios of whole documents and of fixed chunks.

A text that repeats itself compresses far better than prose, random characters
hardly at all. Both kinds are found by bands whose limits depend on the length,
since short inputs give the compressor little to work with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from trigrove.llm.common import col, map_rows


@dataclass(frozen=True)
class Band:
    """Limits of raw size / compressed size for texts of at least ``min_bytes`` bytes."""

    min_bytes: int
    least: float
    most: float


@dataclass(frozen=True)
class CompressionRules:
    """``chunk_bytes`` is the size of the fixed chunks; the last, shorter one counts
    if it holds at least ``min_chunk_bytes``. A document goes if its own ratio is out of the
    band of its length, or if more than ``max_bad_chunks`` of its chunks are
    out of theirs. Documents under the first band's length are kept."""

    bands: tuple[Band, ...] = (
        Band(128, 0.95, 3.5),
        Band(512, 1.2, 4.0),
        Band(2048, 1.4, 5.0),
        Band(16384, 1.5, 6.0),
    )
    chunk_bytes: int = 4096
    min_chunk_bytes: int = 512
    max_bad_chunks: float = 0.5
    level: int = 3


def _score(batch: pa.RecordBatch, at: int, rules: CompressionRules) -> dict[str, list]:
    size_of = zstandard.ZstdCompressor(level=rules.level, write_content_size=True, write_checksum=False).compress
    floors = np.array([b.min_bytes for b in rules.bands])
    least = np.array([-np.inf] + [b.least for b in rules.bands])
    most = np.array([np.inf] + [b.most for b in rules.bands])
    out: dict[str, list] = {"n_bytes": [], "ratio": [], "n_chunks": [], "bad_chunks": [], "verdict": []}
    for text in batch.column(at).to_pylist():
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        n = len(raw)
        ratio = n / len(size_of(raw)) if n else 0.0
        k = int(np.searchsorted(floors, n, side="right"))
        chunks = bad = low = 0
        if n > rules.chunk_bytes:
            for i in range(0, n, rules.chunk_bytes):
                part = raw[i : i + rules.chunk_bytes]
                if len(part) < rules.min_chunk_bytes:
                    continue
                chunks += 1
                r = len(part) / len(size_of(part))
                j = int(np.searchsorted(floors, len(part), side="right"))
                low += r < least[j]
                bad += r < least[j] or r > most[j]
        verdict = "keep"
        if ratio > most[k]:
            verdict = "repetitive"
        elif ratio < least[k]:
            verdict = "incompressible"
        elif bad > rules.max_bad_chunks * chunks:
            verdict = "incompressible_chunks" if 2 * low > bad else "repetitive_chunks"
        for name, x in zip(out, (n, ratio, chunks, int(bad), verdict)):
            out[name].append(x)
    return out


def compression_scores(docs: DataFrame, rules: CompressionRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), ratio, n_chunks, bad_chunks, verdict.

    verdict is keep, repetitive, incompressible, repetitive_chunks or incompressible_chunks.
    A null or empty text has 0 bytes, ratio 0 and is kept, as is any text under
    the first band. Rows are judged alone: a null id stays null, repeated rows
    give repeated results, other columns are not read, an empty table gives none.
    """
    rules = rules or CompressionRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _score(b, 1, rules)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(x["n_bytes"], pa.int64()), pa.array(x["ratio"], pa.float64()), pa.array(x["n_chunks"], pa.int32()), pa.array(x["bad_chunks"], pa.int32()), pa.array(x["verdict"], pa.string())],
                names=["doc_id", "n_bytes", "ratio", "n_chunks", "bad_chunks", "verdict"],
            )

    d = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, n_bytes long, ratio double, n_chunks int, bad_chunks int, verdict string")


def keep_compressible(docs: DataFrame, rules: CompressionRules | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose verdict is keep; nothing is shuffled."""
    rules = rules or CompressionRules()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = np.array([v == "keep" for v in _score(b, at, rules)["verdict"]], bool)
            yield b.filter(pa.array(mask))

    return map_rows(docs, run, docs.schema)
