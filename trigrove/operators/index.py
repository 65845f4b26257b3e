"""The optional trigram index: postings, field masks, statistics, and prefilters over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions.text import gram_rows

#: Bytes of documents for each file of postings, which have several times as many.
_EACH = 16 << 20


def postings(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """segment, doc_id, path, gram: each distinct trigram of each field of stored documents; with ``only`` those that are among them."""
    fields = docs.select("segment", "doc_id", F.explode("fields").alias("path", "value"))
    if only is not None:
        # which of a few trigrams a value holds is found in the scan
        held = F.array_compact(F.array(*[F.when(F.col("value").contains(g), F.lit(g)) for g in dict.fromkeys(only)]))
        return fields.select("segment", "doc_id", "path", F.explode(held).alias("gram"))
    return gram_rows(fields, "value", ["segment", "doc_id", "path"])


def field_masks(docs: DataFrame) -> DataFrame:
    """path and the documents (segment, doc_id) that have it, empty values included; null ones are no fields."""
    return docs.select("segment", "doc_id", F.explode(F.map_keys(F.map_filter("fields", lambda _, v: v.isNotNull()))).alias("path"))


def document_frequency(index: DataFrame) -> DataFrame:
    """gram and the number of documents that hold it."""
    return index.groupBy("gram").agg(F.countDistinct("segment", "doc_id").alias("n_docs"))


def prefilter(index: DataFrame, masks: DataFrame, grams: list[str], mode: str = "and", field: str | None = None) -> DataFrame:
    """segment and doc_id of the candidates: all, any or none of the trigrams, anywhere in the document,
    and the field, if one is given, is there. Without trigrams every document is one."""
    universe = masks.select("segment", "doc_id").distinct()
    if grams:
        hits = index.where(F.col("gram").isin(list(grams)))
        if mode == "and":
            found = hits.groupBy("segment", "doc_id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(set(grams))).select("segment", "doc_id")
        elif mode == "or":
            found = hits.select("segment", "doc_id").distinct()
        elif mode == "not":
            found = universe.join(hits, ["segment", "doc_id"], "left_anti")
        else:
            raise ValueError(f"mode is and, or or not, not {mode!r}")
    else:
        found = universe
    if field:
        found = found.join(masks.where(F.col("path") == field), ["segment", "doc_id"], "left_semi")
    return found


def write_postings(index: DataFrame, path: str, partitions: int) -> None:
    """Postings in order of trigram within each file, so that row-group statistics let a look-up read only what holds its trigrams.

    All of a trigram are in one file. There are ``partitions`` files, or more if what ``index`` reads is large. They are chosen by a hash, since
    ranges would have to be sampled, which makes all postings once more.
    """
    leaves = index._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # a plan whose size isn't known claims the greatest there is
    index.repartition(max(partitions, -(-known // _EACH)), "gram").sortWithinPartitions("gram", "segment", "doc_id").write.mode("errorifexists").parquet(path)


def read_postings(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """The stored postings of some trigrams; row groups of other ones aren't read."""
    return spark.read.schema("segment string, doc_id int, path string, gram string").parquet(path).where(F.col("gram").isin(list(grams)))
