"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

Every passage of every document is a query; an item is retrieved when its score
is at least a share of the score that the item gives itself. Scores are divided by that
self-score, so one threshold serves all items and sums stay additive.

The search is block-max WAND, for all passages of a slice at once. Of each segment the words
that the benchmark has most often are set apart, as long as their contributions stay under a share of the threshold: a passage with none but
those can't reach the threshold. The other words, the segment's pivots, have lists of
blocks with the greatest contribution in each. Only these lists are read, which are the short ones: sums of a block's
maxima, with what its common words could add, tell which blocks a passage can't do without. Blocks that
no pivot leads to, or whose bound is too low, are skipped; what is left is scored exactly.

Retrieved items are then verified: shares of the question's word n-grams and of the
answer's words that occur in order-free form within the passage's surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm import kernels
from trigrove.llm.common import col, map_rows


@dataclass(frozen=True)
class DecontamRules:
    """Passages have 2 * ``half`` words and begin every ``half`` words. Items of more than ``half``
    words are indexed in segments of that many, so that some passage always holds a segment as a whole.

    ``threshold`` is the share of a segment's self-score. The answer is the last sentence of
    an item, extended to ``min_answer`` words; question and answer must overlap by
    ``question`` and ``answer``. Words stay apart from pivots up to ``common`` (under 1) of the threshold. An index of more than ``max_postings`` entries is split by
    items into shards which are searched one after the other, so the size that a task holds is bounded."""

    half: int = 64
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.5
    gram: int = 3
    question: float = 0.4
    answer: float = 0.5
    min_answer: int = 5
    block: int = 2
    common: float = 0.6
    max_postings: int = 4_000_000


def split_item(text: str, min_answer: int) -> tuple[np.ndarray, int]:
    """The hashes of an item's words, and the number of those that are the question.

    A sentence ends with one of . ? ! followed by space; the answer is the last one. If that leaves
    less than three words for a question, the answer is the last ``min_answer`` words, or half of the item if that is less.
    """
    h = next(kernels.words(pa.array([text], pa.string()))).hashes
    body = text.rstrip()
    cut = max((body.rfind(m) for m in (". ", "? ", "! ", ".\n", "?\n", "!\n")), default=-1)
    last = len(next(kernels.words(pa.array([body[cut + 1 :] if cut >= 0 else ""], pa.string()))).hashes)
    short = max(min(min_answer, len(h) // 2), 1 if len(h) > 1 else 0)
    n = short if len(h) - last < 3 else max(last, short)
    return h, len(h) - n


class Index:
    """Normalised BM25 contributions of words to item segments, with maxima per block and list."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], rules: DecontamRules, df: dict[int, int], n_segments: int, mean: float) -> None:
        self.rules, self.items = rules, items
        if not 0 <= rules.common < 1:
            raise ValueError("common must be from 0 to under 1")
        rows = []  # word, segment, contribution, whether it is a pivot
        self.owner, rest = [], []
        for k, (_, h, _) in enumerate(items):
            for a, z in segments(len(h), rules.half):
                words, tf = np.unique(h[a:z], return_counts=True)
                idf = np.array([np.log(1 + (n_segments - df[int(w)] + 0.5) / (df[int(w)] + 0.5)) for w in words])
                c = idf * tf * (rules.k1 + 1) / (tf + rules.k1 * (1 - rules.b + rules.b * (z - a) / mean))
                c = c / c.sum()
                often = np.lexsort((words, [-df[int(x)] for x in words]))
                total = np.cumsum(c[often])
                apart = int(np.searchsorted(total, rules.common * rules.threshold, side="right"))
                pivot = np.ones(len(words), bool)
                pivot[often[:apart]] = False
                rest.append(total[apart - 1] if apart else 0.0)
                rows.append((words, np.full(len(words), len(self.owner)), c, pivot))
                self.owner.append(k)
        w, s, c, pivot = (np.concatenate(x) if rows else np.zeros(0) for x in (zip(*rows) if rows else ((), (), (), ())))
        order = np.lexsort((s, w)) if len(w) else np.zeros(0, int)
        w, s, c, pivot = w[order], s[order].astype(np.int64), c[order], pivot[order].astype(bool)
        self.n_blocks = -(-max(1, len(self.owner)) // rules.block)
        self.vocab, first = np.unique(w, return_index=True)
        self.list_at = np.concatenate((first, [len(w)])).astype(np.int64)
        self.seg, self.part = s, c
        self.list_max = np.maximum.reduceat(c, first) if len(c) else c
        block = s // rules.block
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (block[1:] != block[:-1]))) if len(w) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.block_at = np.searchsorted(at, self.list_at)
        self.entry_key = np.repeat(np.arange(len(self.vocab)), np.diff(self.block_at)) * self.n_blocks + block[at]
        # lists of pivots only: for each word its blocks, with the greatest contribution of a pivot in each
        best = np.maximum.reduceat(np.where(pivot, c, 0.0), at) if len(c) else c
        some = np.flatnonzero(best > 0)
        self.pivot_block, self.pivot_max = block[at][some], best[some]
        self.pivot_at = np.searchsorted(some, self.block_at)
        self.rest = np.zeros(self.n_blocks)
        np.maximum.at(self.rest, np.arange(len(rest)) // rules.block, rest)
        self.post_at = np.concatenate((at, [len(w)])).astype(np.int64)
        self.grams = [np.unique(kernels.ngrams(h[:q], min(rules.gram, max(1, q)))) for _, h, q in items]
        self.answers = [np.unique(h[q:]) for _, h, q in items]
        # a table from the low bits of a hash to a word's number, to pass by most words with one look-up
        self.bits = max(16, int(np.ceil(np.log2(max(2, 8 * len(self.vocab))))))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.vocab & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that the index knows, and their numbers."""
        pos = np.flatnonzero(self.maybe[(h & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.vocab, h[pos]), len(self.vocab) - 1)
        ok = self.vocab[k] == h[pos]
        return pos[ok], k[ok]

    def search(self, w: kernels.Words) -> list[tuple[int, int, float, int, int]]:
        """(row, item, best score, question hits, answer hits) of all verified items."""
        rules = self.rules
        if not len(self.vocab) or not len(w.hashes):
            return []
        n_words = np.diff(w.splits)
        halves = -(-n_words // rules.half)
        half_at = np.concatenate(([0], np.cumsum(halves)))
        pos, word = self.lookup(w.hashes)
        row = np.searchsorted(w.splits, pos, side="right") - 1
        half = half_at[row] + (pos - w.splits[row]) // rules.half
        # each word counts once per half
        code = distinct(half * len(self.vocab) + word)
        half, word = np.divmod(code, len(self.vocab))
        n = int(half_at[-1])
        last = np.zeros(n + 1, bool)
        last[half_at[1:] - 1] = True  # the last half of a row has no neighbour
        best = []

        def pairs(x: np.ndarray) -> np.ndarray:
            y = x.copy()
            y[:-1][~last[: n - 1]] += x[1:][~last[: n - 1]]
            return y

        eps = 1e-9
        top = pairs(np.bincount(half, self.list_max[word], minlength=n))
        alive = top >= rules.threshold - eps
        if not alive.any():
            return []
        feeds = alive.copy()
        feeds[1:] |= alive[:-1] & ~last[: n - 1]
        keep = feeds[half]
        half, word = half[keep], word[keep]
        # sums of pivots' block maxima, only where there are any; a half is part of its own passage and of the one before
        count = self.pivot_at[word + 1] - self.pivot_at[word]
        total = np.concatenate(([0], np.cumsum(count)))
        bounds, lo = [], 0
        while lo < n:
            first = int(np.searchsorted(half, lo))
            # halves of up to so many entries at once, whole ones, and one half more for the last passage
            upto = int(np.searchsorted(total, total[first] + (1 << 21), side="right")) - 1
            hi = max(lo + 1, int(half[upto]) if upto < len(half) else n)
            end = int(np.searchsorted(half, hi + 1))
            some = np.arange(first, end)
            entry = kernels.runs(self.pivot_at[word[some]], count[some])
            own = np.repeat(half[some], count[some])
            block, value = self.pivot_block[entry], self.pivot_max[entry]
            before = (own > lo) & ~last[own - 1]
            here = own < hi
            key = np.concatenate((own[here] * self.n_blocks + block[here], (own[before] - 1) * self.n_blocks + block[before]))
            value = np.concatenate((value[here], value[before]))
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            if len(key):
                at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                p, blk = np.divmod(key[at], self.n_blocks)
                ok = (np.add.reduceat(value, at) + self.rest[blk] >= rules.threshold - eps) & alive[p]
                bounds.append((p[ok], blk[ok]))
            lo = hi
        if not bounds:
            return []
        p, blk = (np.concatenate(x) for x in zip(*bounds))
        found: dict[tuple[int, int], list] = {}
        half_begin = np.searchsorted(half, np.arange(n + 2))
        row_of_half = np.repeat(np.arange(len(halves)), halves)
        for a in range(0, len(p), 1 << 15):
            pp, bb = p[a : a + (1 << 15)], blk[a : a + (1 << 15)]
            lo, hi = half_begin[pp], half_begin[np.where(last[pp], pp + 1, pp + 2)]
            pair = np.repeat(np.arange(len(pp)), hi - lo)
            key = word[kernels.runs(lo, hi - lo)] * self.n_blocks + bb[pair]
            entry = np.minimum(np.searchsorted(self.entry_key, key), len(self.entry_key) - 1)
            ok = self.entry_key[entry] == key
            # a word of both halves counts once
            pair, entry = np.divmod(distinct(pair[ok] * len(self.entry_key) + entry[ok]), len(self.entry_key))
            count = self.post_at[entry + 1] - self.post_at[entry]
            post = kernels.runs(self.post_at[entry], count)
            score = np.bincount(np.repeat(pair, count) * rules.block + self.seg[post] % rules.block, self.part[post], minlength=len(pp) * rules.block)
            for x in np.flatnonzero(score >= rules.threshold - eps):
                i = int(pp[x // rules.block])
                seg = int(bb[x // rules.block]) * rules.block + int(x % rules.block)
                found.setdefault((int(row_of_half[i]), self.owner[seg]), []).append((float(score[x]), i))
        around: dict[int, np.ndarray] = {}
        for (r, k), hits in found.items():
            _, h, q = self.items[k]
            grams, answer = self.grams[k], self.answers[k]
            near = max(2 * rules.half, len(h))
            passed = []  # a passage must meet both limits by itself; one with more of the question may lack the answer
            for _, i in hits:
                a = int(w.splits[r] + (i - half_at[r]) * rules.half)
                lo, hi = max(int(w.splits[r]), a - near), min(int(w.splits[r + 1]), a + 2 * rules.half + near)
                size = min(rules.gram, max(1, q))
                if size not in around:
                    around[size] = kernels.ngrams(w.hashes, size)
                q_hits = held(grams, around[size][lo : max(lo, hi - size + 1)])
                a_hits = held(answer, w.hashes[lo:hi])
                if q_hits >= rules.question * len(grams) and a_hits >= rules.answer * len(answer):
                    passed.append((q_hits, a_hits))
            if passed:
                best.append((r, k, max(score for score, _ in hits), *max(passed)))
        return best


def held(wanted: np.ndarray, there: np.ndarray) -> int:
    """How many of the sorted distinct entries ``wanted`` are in ``there``."""
    if not len(wanted) or not len(there):
        return 0
    k = np.minimum(np.searchsorted(wanted, there), len(wanted) - 1)
    return int(np.count_nonzero(np.bincount(k[wanted[k] == there], minlength=1)))


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct entries."""
    a = np.sort(a)
    keep = np.ones(len(a), bool)
    keep[1:] = a[1:] != a[:-1]
    return a[keep]


def segments(n: int, half: int) -> list[tuple[int, int]]:
    """Pieces of at most ``half`` words; the last one begins early enough to be whole."""
    if n <= half:
        return [(0, n)] if n else []
    return [(a, a + half) for a in range(0, n - half, half)] + [(n - half, n)]


def build_indexes(benchmark: DataFrame, rules: DecontamRules, id_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """The index, in shards of at most ``max_postings`` entries. Benchmarks are small next to a corpus; their texts come to the driver."""
    rows = benchmark.select(col(id_col).cast("long"), col(text_col)).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).distinct().orderBy(id_col, text_col).toLocalIterator()
    items = [(i, *split_item(t, rules.min_answer)) for i, t in rows]
    items = [x for x in items if len(x[1])]
    df: dict[int, int] = {}
    sizes, n, total = [], 0, 0
    for _, h, _ in items:
        size = 0
        for a, z in segments(len(h), rules.half):
            u = np.unique(h[a:z])
            for x in u.tolist():
                df[x] = df.get(x, 0) + 1
            size += len(u)
            n, total = n + 1, total + z - a
        sizes.append(size)
    shards: list[list] = [[]]
    held = 0
    for x, size in zip(items, sizes):
        if shards[-1] and held + size > rules.max_postings:
            shards.append([])
            held = 0
        shards[-1].append(x)
        held += size
    return [Index(s, rules, df, n, total / max(1, n)) for s in shards if s]


_OUT = "doc_id long, item_id long, score double, question_hits int, question_grams int, answer_hits int, answer_words int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: DecontamRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, score (of the best
    passage, as a share of the segment's self-score), question_hits of question_grams, answer_hits of answer_words
    (of the passage with the most hits among those that meet both limits).

    Words are compared in lower case without punctuation. Items and documents that are null or
    have no word, and items with a null id, match nothing; a document's null id stays null. Items that
    repeat an id are items of their own, equal ones count once. Repeated documents repeat their rows. Other columns are not read.
    Documents are only read, never shuffled.
    """
    rules = rules or DecontamRules()
    spark = docs.sparkSession
    d = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    parts = []
    for index in build_indexes(benchmark, rules):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                ids = b.column(0).to_pylist()
                out = []
                for w in kernels.words(b.column(1)):
                    for r, k, score, q, a in index.search(w):
                        out.append((ids[w.rows[0] + r], index.items[k][0], score, q, len(index.grams[k]), a, len(index.answers[k])))
                cols = list(zip(*out)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.float64()] + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "score", "question_hits", "question_grams", "answer_hits", "answer_words"])

        parts.append(d.mapInArrow(run, _OUT))
    if not parts:
        return spark.createDataFrame([], _OUT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rules: DecontamRules | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns as they are; nothing is shuffled."""
    rules = rules or DecontamRules()
    at = docs.columns.index(text_col)
    for index in build_indexes(benchmark, rules):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for w in kernels.words(b.column(at)):
                    for r, *_ in shared.value.search(w):
                        keep[w.rows[0] + r] = False
                yield b.filter(pa.array(keep))

        docs = map_rows(docs, run, docs.schema)
    return docs
