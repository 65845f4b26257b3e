"""Stored documents, from JSON lines or from any table; and segments of them as Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigrove.functions.text import external_id, flatten_fields, normalized
from trigrove.sources.files import Files

STORED = "shard long, gen long, segment string, ord int, doc_id int, ext_id string, fields map<string,string>"


def from_json(lines: DataFrame, json: str = "value", strict_id: bool = False, malformed: str = "fail") -> DataFrame:
    """ext_id and fields of rows of JSON text, other columns kept. Blank rows are left out.

    A missing or other than string _id becomes "", or an error if ``strict_id``; malformed text
    is an error, or is left out if ``malformed`` is "skip".
    """
    rest = [c for c in lines.columns if c != json]
    rows = lines.where(F.trim(F.regexp_replace(json, "[\r﻿]", "")) != "").select(*rest, external_id(json).alias("ext_id"), flatten_fields(json).alias("fields"), F.col(json).alias("__json"))
    if malformed == "skip":
        rows = rows.where("fields IS NOT NULL")
    else:
        rows = rows.withColumn("fields", F.when(F.col("fields").isNotNull(), F.col("fields")).otherwise(F.raise_error(F.concat(F.lit("malformed JSON: "), F.substring("__json", 1, 100))).cast("map<string,string>")))
    if strict_id:
        rows = rows.withColumn("ext_id", F.when(F.col("ext_id").isNotNull(), F.col("ext_id")).otherwise(F.raise_error(F.concat(F.lit("no string _id: "), F.substring("__json", 1, 100))).cast("string")))
    return rows.withColumn("ext_id", F.coalesce("ext_id", F.lit(""))).drop("__json")


def read_jsonl(spark: SparkSession, path: str, **options) -> DataFrame:
    """ext_id and fields of a file of JSON lines, with ``line`` for their order: file, then position in it."""
    rows = spark.read.text(path).withColumn("line", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")))
    return from_json(rows, **options)


def from_table(df: DataFrame, columns: dict[str, str], ext_id: Column | None = None) -> DataFrame:
    """Stored documents of a table: ``columns`` gives for each path the column that is its value, normalized as text. Null values are no fields.

    Without another ext_id that of the path _id, as it stands in the table, is used. All other columns stay.
    """
    parts = [x for path, c in columns.items() for x in (F.lit(path), normalized(F.col(c).cast("string")))]
    ext = ext_id if ext_id is not None else F.col(columns["_id"]).cast("string")
    fields = F.map_filter(F.create_map(*parts), lambda _, v: v.isNotNull())
    return df.withColumn("ext_id", ext).withColumn("fields", fields)


def number(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds doc_id: dense from 0 within each segment, in the given order. For rows of which a segment's fit a task."""
    return df.withColumn("doc_id", (F.row_number().over(Window.partitionBy("segment").orderBy(*order)) - 1).cast("int"))


def write_segment(docs: DataFrame, path: str, order: list[str]) -> None:
    """An immutable segment: doc_id (dense from 0, in the given order), ext_id and fields, in Parquet with checksums of its pages.

    Rows are written aside in ranges of the order, then counted per range; a row's doc_id is its
    range's offset plus its place in it. So many tasks number and write a segment, and none has it whole.
    """
    spark = docs.sparkSession
    folder, _, name = path.rstrip("/").rpartition("/")
    files = Files(spark, folder or "/")
    if files.exists(name) and files.names(name):
        raise FileExistsError(f"{path} is there already")
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    try:
        rows = docs.repartitionByRange(*order).sortWithinPartitions(*order)
        place = F.monotonically_increasing_id()
        rows.select("ext_id", "fields", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("at")).write.parquet(aside)
        staged = spark.read.schema("ext_id string, fields map<string,string>, part int, at int").parquet(_literal(aside))
        # one row per range, of which there are as many as shuffle partitions
        counts = {r.part: r.n for r in staged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        first, offsets = 0, []
        for part in sorted(counts):
            offsets.append((part, first))
            first += counts[part]
        starts = spark.createDataFrame(offsets, "part int, first int")
        d = staged.join(F.broadcast(starts), "part").select((F.col("first") + F.col("at")).alias("doc_id"), "ext_id", "fields")
        d.write.mode("append").option("parquet.page.write-checksum.enabled", "true").parquet(path)
    finally:
        files.delete(aside.rpartition("/")[2])


def open_segments(spark: SparkSession, manifest: list[tuple[int, int, int, str]]) -> DataFrame:
    """Stored documents of the segments of a manifest: (shard, gen, ord, path).

    One scan reads all of them; the manifest's rows, which are few, are joined on by path. A file that is under
    none of the manifest's paths is an error, so that no segment is passed by in silence.
    """
    if not manifest:
        return spark.createDataFrame([], STORED)
    paths = [m[3] for m in manifest]
    prefix = Files.urls(spark, paths)
    rows = spark.createDataFrame([(s, g, o, p, prefix[p]) for s, g, o, p in manifest], "shard long, gen long, ord int, segment string, prefix string")
    data = spark.read.schema("doc_id int, ext_id string, fields map<string,string>").option("parquet.page.verify-checksum.enabled", "true").parquet(*[_literal(p) for p in paths])
    known = set(prefix.values())
    for f in data.inputFiles():
        if (folder := Files.plain(f).rpartition("/")[0]) not in known:
            raise ValueError(f"{folder} is in no segment of the manifest")
    data = data.withColumn("prefix", F.regexp_replace(F.regexp_replace("_metadata.file_path", r"^file:/+", "file:/"), r"/[^/]*$", ""))
    return data.join(F.broadcast(rows), "prefix").select("shard", "gen", "segment", "ord", "doc_id", "ext_id", "fields")


def _literal(path: str) -> str:
    """The path with signs that a reader takes for patterns escaped."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def get_docs(docs: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    """The stored documents with these (segment, doc_id)."""
    keys = docs.sparkSession.createDataFrame(wanted, "segment string, doc_id int")
    return docs.join(F.broadcast(keys), ["segment", "doc_id"], "left_semi")


def segment_format(spark: SparkSession, path: str) -> str:
    """"parquet", "json" (a folder with docs.jsonl, the older layout), or "unknown"."""
    files = Files(spark, path)
    names = files.names("")
    if "docs.jsonl" in names:
        return "json"
    return "parquet" if any(n.endswith(".parquet") for n in names) else "unknown"


def import_legacy_segment(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ext_id and fields of a segment in the JSON layout (docs.jsonl with these three names)."""
    return spark.read.schema("doc_id int, ext_id string, fields map<string,string>").json(f"{_literal(folder)}/docs.jsonl")


def open_any(spark: SparkSession, manifest: list[tuple[int, int, int, str]]) -> DataFrame:
    """Like ``open_segments``, for segments of either format, which is found out for each. ValueError for an unknown one."""
    found = {m[3]: segment_format(spark, m[3]) for m in manifest}
    if bad := [p for p, f in found.items() if f == "unknown"]:
        raise ValueError(f"no segment: {', '.join(bad)}")
    out = open_segments(spark, [m for m in manifest if found[m[3]] == "parquet"])
    for s, g, o, p in manifest:
        if found[p] == "json":
            d = import_legacy_segment(spark, p)
            out = out.unionByName(d.select(F.lit(s).cast("long").alias("shard"), F.lit(g).cast("long").alias("gen"), F.lit(p).alias("segment"), F.lit(o).alias("ord"), "doc_id", "ext_id", "fields"))
    return out


def content_hash(docs: DataFrame) -> DataFrame:
    """segment and a hash of its documents, whatever their order in the files."""
    entries = F.array_sort(F.map_entries("fields"))
    return docs.groupBy("segment").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.xxhash64("doc_id", "ext_id", entries).cast("decimal(20,0)")).cast("string").alias("content_hash"))


class Damaged(ValueError):
    """A segment isn't what its catalog says."""


def seal(spark: SparkSession, path: str) -> dict:
    """Writes the catalog of a segment: its number of documents and the hash of their contents."""
    docs = open_segments(spark, [(0, 0, 0, path)])
    row = content_hash(docs).first()
    entry = {"n_docs": row.n_docs, "content_hash": row.content_hash} if row else {"n_docs": 0, "content_hash": "0"}
    Files(spark, path).replace("_catalog.json", json.dumps(entry))
    return entry


def verify(spark: SparkSession, path: str) -> dict:
    """The catalog of a sealed segment; Damaged if the documents that are there are others."""
    entry = json.loads(Files(spark, path).read("_catalog.json"))
    row = content_hash(open_segments(spark, [(0, 0, 0, path)])).first()
    found = (row.n_docs, row.content_hash) if row else (0, "0")
    if found != (entry["n_docs"], entry["content_hash"]):
        raise Damaged(f"{path}: {found[0]} documents with the hash {found[1]}, the catalog has {entry['n_docs']} and {entry['content_hash']}")
    return entry
