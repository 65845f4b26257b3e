"""Best-two-fit packing of documents into bins of a fixed number of tokens.

A bin is filled greedily with the longest documents that still fit. Then its smallest
document is taken out again, if two unpacked documents together fill the gap
that this leaves more tightly than it did. Only ids and lengths are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm import kernels
from trigrove.llm.common import col, cut


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices into ``lengths``, whose entries are from 1 to ``capacity``.

    Equal lengths go in order of index. Deterministic.
    """
    stacks: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(lengths[i], []).append(i)
    present = 0  # bit n is set while a document of length n is unpacked
    for n in stacks:
        present |= 1 << n

    def longest(most: int) -> int:
        """The greatest length of an unpacked document up to ``most``, or 0."""
        return (present & ((2 << most) - 1)).bit_length() - 1 if most > 0 and present & ((2 << most) - 1) else 0

    def pop(n: int) -> int:
        nonlocal present
        i = stacks[n].pop()
        if not stacks[n]:
            present &= ~(1 << n)
        return i

    bins = []
    left = len(lengths)
    while left:
        gap, chosen = capacity, []
        while gap and (n := longest(gap)):
            chosen.append(pop(n))
            gap -= n
            left -= 1
        if gap and left > 1:
            small = lengths[chosen[-1]]  # lengths fall within a bin
            room = gap + small
            best, pair = small, None
            a = longest(room - 1)
            while a and 2 * a > best:
                most = min(a, room - a)
                b = longest(most)
                if b == a and len(stacks[a]) < 2:
                    b = longest(a - 1)
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = longest(a - 1)
            if pair:
                i = chosen.pop()
                x, y = pop(pair[0]), pop(pair[1])
                stacks.setdefault(small, []).append(i)
                present |= 1 << small
                chosen += [x, y]
                left -= 1
        bins.append(chosen)
    return bins


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens, the number of words of the text (0 for null and empty ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.concatenate([np.zeros(0, np.int64)] + [np.diff(w.splits) for w in kernels.words(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["doc_id", "n_tokens"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def pack(counts: DataFrame, capacity: int = 2048, shard_docs: int = 50_000) -> DataFrame:
    """One row per bin: bin_id ("shard-number"), used, n_pieces, doc_ids, begins, lengths.

    ``counts`` has doc_id and n_tokens. A document longer than ``capacity`` is cut: as many pieces
    of ``capacity`` tokens as it gives are bins of their own, the rest is packed like
    a document. begins and lengths tell, for each entry of doc_ids, which
    tokens of the document it is. Documents are spread by a hash of doc_id
    over shards of about ``shard_docs`` documents, which are packed apart, so the
    number of shards follows the input and each fits in memory. Null ids and
    counts, and counts of 0 or less, are in no bin. Rows that repeat a doc_id count once, with
    the greatest count. Ties go in order of doc_id; an empty table gives no rows.
    """
    d = counts.select(col("doc_id").cast("long").alias("doc_id"), col("n_tokens").cast("long").alias("n_tokens")).where("doc_id IS NOT NULL AND n_tokens > 0")
    d = cut(d.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")))
    shards = max(1, -(-d.count() // shard_docs))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids, tokens = pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()
        shard = int(pdf["shard"].iloc[0])
        rows, rest, owner = [], [], []
        for i, n in zip(ids, tokens):
            whole = n // capacity
            for k in range(whole):
                rows.append((capacity, 1, [i], [k * capacity], [capacity]))
            if n % capacity:
                rest.append(n % capacity)
                owner.append((i, whole * capacity))
        for b in pack_lengths(rest, capacity):
            rows.append((sum(rest[j] for j in b), len(b), [owner[j][0] for j in b], [owner[j][1] for j in b], [rest[j] for j in b]))
        out = pd.DataFrame(rows, columns=["used", "n_pieces", "doc_ids", "begins", "lengths"])
        out.insert(0, "bin_id", [f"{shard}-{j}" for j in range(len(out))])
        return out

    return d.groupBy("shard").applyInPandas(run, "bin_id string, used long, n_pieces long, doc_ids array<long>, begins array<long>, lengths array<long>")
