"""Long repeated spans by a compacted de Bruijn graph of word k-mers.

Every k-mer of words is an edge. K-mers are routed in runs by their minimizer, so
equal ones meet in one partition. Minimizers are counted first: runs of one that occurs once hold no
repeated k-mer and stay where they are. K-mers that occur twice or more are the repeated edges. A link
between two edges that follow one another does not branch when both occur equally often and each
occurrence of the one goes on to the other. Chains within a minimizer's run are compacted where they are
found, into pieces; pieces are joined to whole paths through Spark joins on their links. Last, the
words at the source coordinates of each path are read again and compared, by hashes of another make.

A minimizer that would fill a partition by itself isn't gathered: its distinct runs are counted where they
are, and only their k-mers, each run's once, are counted and compacted by aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trigrove.llm import kernels
from trigrove.llm.common import by_key, col, cut, kept, sifted

#: Words of the shorter n-grams of which the least is a k-mer's minimizer.
MINIMIZER = 8
#: Occurrences from which a minimizer may count as one that fills a partition.
HOT = 50_000
_SIEVE_BITS = 27


def _fills(total: int, partitions: int) -> int:
    """From how many occurrences on a minimizer is hot. Of ``total`` occurrences at most four for each partition have as many, so their list is short."""
    return max(HOT, total // (4 * partitions))


class _Runs(NamedTuple):
    """K-mers of a slice in runs of equal minimizers: of each run the minimizer, row, first word and number of k-mers."""

    kmers: np.ndarray
    mz: np.ndarray
    row: np.ndarray
    start: np.ndarray
    n: np.ndarray


def _runs(w: kernels.Words, k: int) -> _Runs | None:
    g = kernels.ngrams(w.hashes, k)
    ends = w.ends()[: len(g)]
    at = np.flatnonzero(np.arange(len(g)) + k <= ends)
    if not len(at):
        return None
    m = min(MINIMIZER, k)
    mz = kernels.window_min(kernels.ngrams(w.hashes, m, seed=7), k - m + 1)[at]
    row = w.row_of()[at]
    new = np.ones(len(at), bool)
    new[1:] = (mz[1:] != mz[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    return _Runs(g[at], mz[head], row[head], at[head] - w.splits[row[head]], np.diff(np.concatenate((head, [len(at)]))))


def _minimizers(docs: DataFrame, k: int) -> DataFrame:
    """mz and n, the number of runs that have it, of those that occur more than once or in a run that repeats a k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for w in kernels.words(b.column(0)):
                r = _runs(w, k)
                if r is not None:
                    order = np.argsort(r.kmers, kind="stable")
                    twice = order[1:][r.kmers[order[1:]] == r.kmers[order[:-1]]]
                    found += [r.mz, r.mz[np.unique(np.searchsorted(np.cumsum(r.n), twice, side="right"))]]
            if found:
                mz, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(mz.view(np.int64)), pa.array(n)], names=["mz", "n"])

    return docs.select("text").mapInArrow(run, "mz long, n long").groupBy("mz").agg(F.sum("n").alias("n")).where("n > 1")


def _sieve(counts: DataFrame) -> np.ndarray:
    """A bit for each minimizer that occurs more than once, by its top bits: of bounded size, with very many of them more pass."""
    at = F.shiftrightunsigned("mz", 64 - _SIEVE_BITS)
    parts = counts.groupBy(F.shiftright(at, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).toArrow()
    out = np.zeros((1 << _SIEVE_BITS) // 8, np.uint8)
    for part, x in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist()):
        out[part * 4096 : part * 4096 + len(x)] = np.frombuffer(x, np.uint8)
    return out


def _routed(docs: DataFrame, k: int, sieve, hot: np.ndarray) -> DataFrame:
    """mz, doc_id, start (word at which the run's first k-mer begins) and kmers of the runs that may hold repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for w in kernels.words(b.column(1)):
                r = _runs(w, k)
                if r is None:
                    continue
                pos = r.mz >> np.uint64(64 - _SIEVE_BITS)
                keep = (bits[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 == 1
                keep &= ~np.isin(r.mz, hot)
                some = np.flatnonzero(keep)
                blob = kernels.binary(r.kmers[np.repeat(keep, r.n)], r.n[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.mz[some].view(np.int64)), pa.array(ids[w.rows[0] + r.row[some]]), pa.array(r.start[some].astype(np.int32)), blob],
                    names=["mz", "doc_id", "start", "kmers"],
                )

    return docs.mapInArrow(run, "mz long, doc_id long, start int, kmers binary")


_PIECE = "piece long, doc_id long, start int, n int, copies int"


def _pieces(routed: DataFrame) -> DataFrame:
    """Occurrences of compacted repeated chains: piece, doc_id, start, n (k-mers) and copies."""

    def compact(x: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        mz, doc, start = (x.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        blobs = x.column(3)
        off = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
        n = np.diff(off) // 8
        key = np.frombuffer(blobs.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint64)
        # rows that repeat a doc_id bring the same coordinates again
        again = np.zeros(len(mz), bool)
        again[1:] = (mz[1:] == mz[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
        if again.any():
            keep = ~again
            key = key[np.repeat(keep, n)]
            mz, doc, start, n = mz[keep], doc[keep], start[keep], n[keep]
        total = len(key)
        if not total:
            return
        row = np.repeat(np.arange(len(mz)), n)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.ones(total, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        at = np.flatnonzero(new)
        count = np.diff(np.concatenate((at, [total])))
        group = np.empty(total, np.int64)
        group[order] = np.cumsum(new) - 1
        copies = count[group]
        # a chain goes on where all occurrences of an edge are followed, within the run, by the same edge, which has no others
        follow = np.full(total, -1, np.int64)
        inner = row[1:] == row[:-1]
        follow[:-1][inner] = group[1:][inner]
        by_group = follow[order]
        low, high = np.minimum.reduceat(by_group, at), np.maximum.reduceat(by_group, at)
        goes_on = ((low == high) & (low >= 0))[group]
        link = np.zeros(total, bool)
        link[:-1] = goes_on[:-1] & (copies[:-1] == copies[1:])
        used = np.flatnonzero(copies > 1)
        if not len(used):
            return
        linked = np.zeros(len(used), bool)
        linked[1:] = link[used[1:] - 1] & (used[1:] == used[:-1] + 1)
        head = np.flatnonzero(~linked)
        length = np.diff(np.concatenate((head, [len(used)])))
        k = used[head]
        within = k - np.repeat(np.cumsum(n) - n, n)[k]
        piece = kernels.mix64(key[k] + length.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece.view(np.int64)), pa.array(doc[row[k]]), pa.array((start[row[k]] + within).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(copies[k].astype(np.int32))],
            names=["piece", "doc_id", "start", "n", "copies"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, _ in by_key(batches, 60_000):
            yield from compact(whole)

    return routed.repartition("mz").sortWithinPartitions("mz", "doc_id", "start").mapInArrow(run, _PIECE)


_RUN = "run long, doc_id long, start int, kmers binary"


def _hot_runs(docs: DataFrame, k: int, hot: np.ndarray, single: bool) -> DataFrame:
    """run (a hash of its k-mers), doc_id and start of the runs of hot minimizers; kmers of the first one of each slice. With ``single`` each k-mer is a run, and has kmers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for w in kernels.words(b.column(1)):
                r = _runs(w, k)
                keep = np.isin(r.mz, hot) if r is not None else np.zeros(0, bool)
                if not keep.any():
                    continue
                n, row, start = r.n[keep], r.row[keep], r.start[keep]
                key = r.kmers[np.repeat(keep, r.n)]
                if single:
                    row, start, n = np.repeat(row, n), kernels.runs(start, n), np.ones(len(key), np.int64)
                name = kernels.spans(key, np.cumsum(n) - n, n)
                _, first = np.unique(name, return_index=True)
                sent = np.zeros(len(n), bool)
                sent[slice(None) if single else first] = True
                blob = kernels.binary(key[np.repeat(sent, n)], n[sent])
                blob = blob.take(pa.array(np.cumsum(sent) - 1, mask=~sent))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(ids[w.rows[0] + row]), pa.array(start.astype(np.int32)), blob], names=["run", "doc_id", "start", "kmers"])

    return docs.select("doc_id", "text").mapInArrow(run, _RUN)


def _hot_pieces(docs: DataFrame, k: int, hot: np.ndarray) -> DataFrame:
    """The same of the k-mers of hot minimizers.

    What makes a minimizer hot is mostly a passage that very many documents have, so their runs hold the same
    k-mers. These are counted and compacted once for each distinct run, by aggregations over its k-mers, and no task gathers a minimizer.
    """

    def kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(1).to_pylist()
            n = np.array([len(x) // 8 for x in blobs], np.int64)
            key = np.frombuffer(b"".join(blobs), np.int64)
            last = np.zeros(len(key), bool)
            last[np.cumsum(n) - 1] = True
            take = pa.array(np.repeat(np.arange(len(n)), n))
            pos = kernels.runs(np.zeros(len(n), np.int64), n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(pos), b.column(2).take(take), pa.array(key), pa.array(np.roll(key, -1), mask=last)], names=["run", "pos", "w", "h", "follow"])

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the repeated k-mers of each run, in order, to pieces
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            pos, key, copies, goes_on = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            row = np.repeat(np.arange(b.num_rows), sizes)
            linked = np.zeros(len(pos), bool)
            linked[1:] = (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1) & goes_on[:-1] & (copies[1:] == copies[:-1])
            head = np.flatnonzero(~linked)
            length = np.diff(np.concatenate((head, [len(pos)])))
            piece = kernels.mix64(key[head].view(np.uint64) + length.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row[head])), pa.array(pos[head]), pa.array(piece.view(np.int64)), pa.array(length.astype(np.int32)), pa.array(copies[head].astype(np.int32))],
                names=["run", "at", "piece", "n", "copies"],
            )

    # texts of one id may have other runs at the same coordinates, whose k-mers count once; a passage that such texts hold stays in single k-mers
    twice = cut(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        rows = _hot_runs(docs, k, hot, False)
    else:
        rows = _hot_runs(docs.join(twice, "doc_id", "left_semi"), k, hot, True).dropDuplicates(["run", "doc_id", "start"])
        rows = rows.unionByName(_hot_runs(docs.join(twice, "doc_id", "left_anti"), k, hot, False))
    rows = kept(rows)
    runs = rows.where("kmers IS NOT NULL").groupBy("run").agg(F.max("kmers").alias("kmers")).join(rows.groupBy("run").agg(F.count(F.lit(1)).alias("w")), "run")
    each = kept(runs.select("run", "kmers", "w").mapInArrow(kmers, "run long, pos int, w long, h long, follow long"))
    ends = F.count(F.lit(1)) > F.count("follow")
    stats = each.groupBy("h").agg(F.sum("w").alias("copies"), (~ends & (F.min("follow") == F.max("follow"))).alias("goes_on")).where("copies > 1")
    repeated = each.select("run", "pos", "h").join(stats, "h").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "copies", F.coalesce("goes_on", F.lit(False)).alias("goes_on")))).alias("all"))
    pieces = repeated.mapInArrow(compact, "run long, at int, piece long, n int, copies int")
    return rows.select("run", "doc_id", "start").join(pieces, "run").select("piece", "doc_id", (F.col("start") + F.col("at")).alias("start"), "n", "copies")


def _paths(pieces: DataFrame) -> DataFrame:
    """For each document its occurrences of whole nonbranching paths: doc_id and spans of path (its first piece), start and n."""
    by_doc = Window.partitionBy("doc_id").orderBy("start")
    p = pieces.withColumn("next_piece", F.lead("piece").over(by_doc)).withColumn("next_start", F.lead("start").over(by_doc)).withColumn("next_copies", F.lead("copies").over(by_doc))
    p = p.withColumn("next_piece", F.when((F.col("next_start") == F.col("start") + F.col("n")) & (F.col("next_copies") == F.col("copies")), F.col("next_piece"))).drop("next_start", "next_copies")
    links = p.where("next_piece IS NOT NULL").groupBy("piece", "next_piece").agg(F.count(F.lit(1)).alias("m"), F.first("copies").alias("c")).where("m = c").select("piece", "next_piece", F.lit(True).alias("single"))
    q = p.drop("copies").join(links, ["piece", "next_piece"], "left")
    q = q.withColumn("head", ~F.coalesce(F.lag("single").over(by_doc), F.lit(False)))
    q = q.withColumn("chain", F.sum(F.col("head").cast("int")).over(by_doc))
    g = q.groupBy("doc_id", "chain").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min_by("piece", "start").alias("path"))
    return g.groupBy(F.col("doc_id").alias("sid")).agg(F.collect_list(F.struct("path", "start", "n")).alias("spans"))


def _read_again(paths: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """path, n, seen (a hash of the words at the coordinates, read anew from the documents), doc_id and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(2)
            for w in kernels.words(b.column(1), seed=3):
                lo, hi = w.rows
                part = spans.slice(lo, hi - lo)
                sizes = np.diff(part.offsets.to_numpy()) if len(part) else np.zeros(0, np.int64)
                flat = part.flatten()
                path, start, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                row = np.repeat(np.arange(hi - lo), sizes)
                a = w.splits[row] + start
                ok = a + n + k - 1 <= w.splits[row + 1]
                seen = kernels.spans(w.hashes, a[ok], n[ok].astype(np.int64) + k - 1)
                doc = b.column(0).slice(lo, hi - lo).take(pa.array(row[ok]))
                yield pa.RecordBatch.from_arrays([pa.array(path[ok]), pa.array(n[ok]), pa.array(seen.view(np.int64)), doc, pa.array(start[ok])], names=["path", "n", "seen", "doc_id", "start"])

    joined = sifted(docs, "doc_id", paths.select("sid")).join(paths.hint("shuffle_hash"), F.col("doc_id") == F.col("sid")).select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "path long, n int, seen long, doc_id long, start int")


def repeated_spans(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per occurrence of a repeated span: doc_id, start_word, n_words, path, copies, first_doc, first_word, is_first, across.

    A word is covered if and only if it is in a run of ``min_words`` words that the corpus holds at least twice, in
    one document or in several. Each row is an occurrence of a nonbranching path of the graph:
    all ``copies`` occurrences of a path (equal ``path``) hold the same ``n_words`` words, and the first one by
    doc_id and position is is_first; across tells whether several documents have it, or one document repeats itself. Where a longer repeat and a shorter one share
    words they are paths apart, which overlap by ``min_words`` - 1 words. Words are compared in lower case without punctuation.
    K-mers are told apart by 64-bit hashes, the words of whole spans by a second hash of 64 bits; occurrences that
    differ in it are paths apart, and copies counts those that agree in both.

    Null ids, and texts that are null or have fewer words, have no spans. Rows that repeat a doc_id are one
    document: equal coordinates with equal words count once. Other columns are not read; an empty table gives no rows.
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    spark = docs.sparkSession
    d = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    counts = cut(_minimizers(d, min_words))
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = _fills(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = np.array([r.mz for r in counts.where(F.col("n") > most).select("mz").collect()], np.int64).view(np.uint64)
    pieces = _pieces(_routed(d, min_words, spark.sparkContext.broadcast(_sieve(counts)), hot))
    if len(hot):
        pieces = pieces.unionByName(_hot_pieces(d, min_words, hot))
    paths = kept(_paths(kept(pieces)))
    rows = _read_again(paths, d, min_words).distinct()
    same = rows.groupBy("path", "n", "seen").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last")).where("copies > 1")
    good = rows.join(same, ["path", "n", "seen"])
    return good.select(
        "doc_id",
        F.col("start").alias("start_word"),
        (F.col("n") + (min_words - 1)).alias("n_words"),
        F.xxhash64("path", "n", "seen").alias("path"),
        "copies",
        F.col("first.doc_id").alias("first_doc"),
        F.col("first.start").alias("first_word"),
        ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start"))).alias("is_first"),
        (F.col("first.doc_id") < F.col("last")).alias("across"),
    )
