"""Wildcard search over stored documents (shard, gen, segment, ord, doc_id, ext_id, fields).

The plan scans once: literal runs and the pattern become contains and LIKE within
whole-stage codegen. Nothing is shuffled before rows are down to candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigrove.functions.pattern import Pattern, compile_pattern
from trigrove.functions.preview import preview, truncated

#: The order of hits: shards up, newest generation first, segments as in the manifest, then documents.
ORDER = (F.asc, "shard"), (F.desc, "gen"), (F.asc, "ord"), (F.asc, "doc_id")


def order_columns() -> list[Column]:
    return [f(c) for f, c in ORDER]


@dataclass(frozen=True)
class SearchOptions:
    field: str | None = None
    paths: tuple[str, ...] = ()
    max_candidates: int | None = 200_000
    segment_hits: int | None = 1024
    preview_mode: str = "literal"
    preview_chars: int = 180
    allow_weak: bool = False


def matched_field(fields: Column, pattern: Pattern, only: str | None = None, paths: tuple[str, ...] = ()) -> Column:
    """The first path, in byte order, whose value matches; of ``only`` that one. Null if none does.

    With ``paths``, the documents' fields are known and are tested one by one, so that only what is needed is evaluated.
    """
    if only:
        return F.when(pattern.matches(fields[only]), F.lit(only))
    if paths:
        return F.coalesce(*[F.when(pattern.matches(fields[p]), F.lit(p)) for p in sorted(paths, key=str.encode)])
    return F.array_min(F.map_keys(F.map_filter(fields, lambda k, v: pattern.matches(v))))


def candidates(docs: DataFrame, pattern: Pattern, options: SearchOptions | None = None, mode: str = "and") -> DataFrame:
    """The documents that pass the prefilter: trigrams in any one field each, and the wanted field is there."""
    options = options or SearchOptions()
    f = F.col("fields")
    out = docs
    if options.field:
        out = out.where(f[options.field].isNotNull())
    if not pattern.grams:
        return out
    values = [f[p] for p in options.paths]

    def held(gram: str) -> Column:
        if values:
            return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(v.contains(gram), F.lit(False)) for v in values]), F.lit(False))
        return F.exists(F.map_values(f), lambda v: F.coalesce(v.contains(gram), F.lit(False)))

    parts = [held(g) for g in pattern.grams]
    if mode == "and":
        return out.where(reduce(lambda a, b: a & b, parts))
    if mode == "or":
        return out.where(reduce(lambda a, b: a | b, parts))
    if mode == "not":
        return out.where(~reduce(lambda a, b: a | b, parts))
    raise ValueError(f"mode is and, or or not, not {mode!r}")


def _after_cursor(df: DataFrame, cursor: dict[str, int]) -> DataFrame:
    if not cursor:
        return df
    rows = df.sparkSession.createDataFrame(sorted(cursor.items()), "segment string, last_docid long")
    return df.join(F.broadcast(rows), "segment", "left").where("doc_id > coalesce(last_docid, -1)").drop("last_docid")


def upto_cursor(df: DataFrame, cursor: dict[str, int]) -> DataFrame:
    """The rows that earlier pages have passed."""
    rows = df.sparkSession.createDataFrame(sorted(cursor.items()), "segment string, last_docid long")
    return df.join(F.broadcast(rows), "segment").where("doc_id <= last_docid").drop("last_docid")


def limited(docs: DataFrame, pattern: Pattern, options: SearchOptions, cursor: dict[str, int]) -> DataFrame:
    """What one look at the segments after the cursor sees: shard, gen, ord, segment, doc_id, ext_id, matched_field
    (null where a candidate is no hit) and n_hit, the number of hits of the segment up to the row.

    At most max_candidates candidates and segment_hits hits of each segment, and one candidate more (``over``) where there are
    more. Windows hold no texts.
    """
    f = F.col("fields")
    slim = candidates(_after_cursor(docs, cursor), pattern, options).select("shard", "gen", "ord", "segment", "doc_id", "ext_id", matched_field(f, pattern, options.field, options.paths).alias("matched_field"))
    rank = Window.partitionBy("segment").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    out = slim.withColumn("n", F.count(F.lit(1)).over(rank)).withColumn("n_hit", F.count("matched_field").over(rank))
    over = F.lit(False)
    if options.max_candidates is not None:
        over = over | (F.col("n") > options.max_candidates)
    if options.segment_hits is not None:
        over = over | (F.col("n_hit") > options.segment_hits)
    out = out.withColumn("over", over)
    first = F.min(F.when(F.col("over"), F.col("doc_id"))).over(Window.partitionBy("segment"))
    return out.withColumn("end", first).where("end IS NULL OR doc_id <= end").drop("n", "end")


def search(docs: DataFrame, wildcard: str, options: SearchOptions | None = None, cursor: dict[str, int] | None = None) -> DataFrame:
    """All hits after the cursor: shard, gen, ord, segment, doc_id, ext_id, matched_field, preview. Raises PatternTooWeak.

    max_candidates counts, per segment, documents after the cursor that pass the prefilter; segment_hits hits after it.
    """
    options = options or SearchOptions()
    pattern = compile_pattern(wildcard, options.allow_weak)
    f = F.col("fields")
    docs = _after_cursor(docs, cursor or {})
    found = docs if options.max_candidates is None else candidates(docs, pattern, options)
    value = F.col("fields")[F.col("matched_field")] if not options.field else f[options.field]
    rows = found.withColumn("matched_field", matched_field(f, pattern, options.field, options.paths))
    if options.max_candidates is None:
        rows = rows.where("matched_field IS NOT NULL")
    if options.preview_mode == "hot":
        shown = truncated(value, options.preview_chars)
    else:
        shown = preview(value, pattern, options.preview_mode, options.preview_chars)
    rows = rows.select("shard", "gen", "ord", "segment", "doc_id", "ext_id", "matched_field", F.when(F.col("matched_field").isNotNull(), shown).alias("preview"))
    if options.max_candidates is not None:
        rank = Window.partitionBy("segment").orderBy("doc_id")
        rows = rows.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= options.max_candidates).where("matched_field IS NOT NULL").drop("__n")
    if options.segment_hits is not None:
        rank = Window.partitionBy("segment").orderBy("doc_id")
        rows = rows.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= options.segment_hits).drop("__n")
    return rows


def dedup(hits: DataFrame) -> DataFrame:
    """Hits with ``rank``: 1 is the first of its external id in the order of hits. Hits without an id are all first."""
    named = F.coalesce(F.col("ext_id"), F.lit("")) != ""
    # hits without an id must not meet in one window partition: each is one of its own
    alone = F.when(~named, F.concat_ws(":", "segment", F.col("doc_id").cast("string")))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("ext_id", alone).orderBy(*order_columns())))


def page(ranked: DataFrame, size: int, cursor: dict[str, int] | None = None) -> DataFrame:
    """The next ``size`` hits of rank 1 after the cursor, in the order of hits."""
    return _after_cursor(ranked.where("rank = 1"), cursor or {}).orderBy(*order_columns()).limit(size).drop("rank")


def next_cursor(ranked: DataFrame, page_rows: DataFrame, cursor: dict[str, int] | None = None) -> DataFrame:
    """segment and last_docid after a page: the last row that was emitted, or dropped as a duplicate before the page's end.

    A segment without such a row keeps its cursor, or has none.
    """
    spark = ranked.sparkSession
    key = F.struct(F.col("shard"), (-F.col("gen")).alias("g"), F.col("ord"), F.col("doc_id"))
    last = page_rows.agg(F.max(key).alias("last"))
    passed = ranked.crossJoin(F.broadcast(last)).where(key <= F.col("last")).groupBy("segment").agg(F.max("doc_id").cast("long").alias("last_docid"))
    old = spark.createDataFrame(sorted((cursor or {}).items()), "segment string, last_docid long")
    return passed.unionByName(old).groupBy("segment").agg(F.max("last_docid").alias("last_docid"))


def stats(docs: DataFrame, wildcard: str, options: SearchOptions | None = None) -> DataFrame:
    """candidates, hits and, per matched field, hits: one row per field that has any, and one with a null field for the totals."""
    options = options or SearchOptions()
    pattern = compile_pattern(wildcard, options.allow_weak)
    rows = candidates(docs, pattern, options).select(matched_field(F.col("fields"), pattern, options.field, options.paths).alias("matched_field"))
    counts = rows.groupBy("matched_field").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.coalesce(F.sum(F.when(F.col("matched_field").isNotNull(), F.col("n"))), F.lit(0)).alias("hits"))
    return total.select(F.lit(None).cast("string").alias("matched_field"), "candidates", "hits").unionByName(counts.where("matched_field IS NOT NULL").select("matched_field", F.col("n").alias("candidates"), F.col("n").alias("hits")))
