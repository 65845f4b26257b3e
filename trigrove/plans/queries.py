"""Queries over the driver's tables, one or more per operator, with their SQL.

Documents are taken as stored documents: fields _id, lang, source and text, segments of
100 documents, four shards.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions.pattern import compile_pattern
from trigrove.functions.preview import label_field, literal_preview, preview, span_preview, truncated
from trigrove.functions.text import flatten_fields, gram_rows, normalized
from trigrove.operators import index, search
from trigrove.plans.engine import Config, Engine, SearchRequest
from trigrove.sources import documents
from trigrove.sources.files import shared_folder
from trigrove.sources.manifest import Manifest, ManifestConflict
from trigrove.streaming.ingest import Backpressure, Ingestor

PATHS = ("_id", "lang", "source", "text")
_N = "strip_accents(lower({}))"
_TEXT = _N.format("text")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(df: DataFrame) -> DataFrame:
    s = F.floor(F.col("doc_id") / 100)
    return df.withColumns({"segment": F.concat(F.lit("seg-"), s.cast("string")), "shard": s % 4, "gen": s % 4 + 1, "ord": F.floor(s / 4).cast("int")})


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents.from_table(_placed(_table(spark, sf_dir, "documents")), {"_id": "doc_id", "lang": "lang", "source": "source", "text": "text"})
    return d.select("shard", "gen", "segment", "ord", (F.col("doc_id") % 100).cast("int").alias("doc_id"), "ext_id", "fields")


#: The stored documents in SQL: gid is the table's doc_id.
_D = f"""d AS (SELECT doc_id AS gid, CAST(doc_id AS VARCHAR) AS ext_id, {_N.format("lang")} AS lang, {_N.format("source")} AS source, {_TEXT} AS text,
    'seg-' || CAST(doc_id // 100 AS VARCHAR) AS segment, (doc_id // 100) % 4 AS shard, (doc_id // 100) % 4 + 1 AS gen, CAST((doc_id // 100) // 4 AS INTEGER) AS ord, CAST(doc_id % 100 AS INTEGER) AS doc_id FROM documents)"""
_ORDER = "shard, gen DESC, ord, doc_id"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# scalar functions


@_query("normalize_text", f"SELECT doc_id, {_TEXT} AS text FROM documents")
def _(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", normalized("text").alias("text"))


def _matching(wildcard: str, table: str, key: list[str], value: str) -> Callable:
    p = compile_pattern(wildcard)
    return lambda spark, sf: _table(spark, sf, table).where(p.matches(normalized(value))).select(*key)


for _name, _wild, _like in (
    ("wildcard_contains", "*ention*", "%ention%"),
    ("wildcard_multi", "*ent*rie*", "%ent%rie%"),
    ("wildcard_qmark", "e?ti*the", "%e_ti%the%"),
    ("wildcard_unanchored", "Thé", "%the%"),
    ("wildcard_literal_signs", "%%%", "%\\%\\%\\%%"),
):
    _query(_name, f"SELECT doc_id FROM documents WHERE {_TEXT} LIKE '{_like}' ESCAPE '\\'")(_matching(_wild, "documents", ["doc_id"], "text"))
_query("conversation_search", f"SELECT conv_id, turn, role FROM conversations WHERE {_TEXT} LIKE '%quel%ent%'")(_matching("quel*ent", "conversations", ["conv_id", "turn", "role"], "text"))
_query("page_html_search", f"SELECT page_id, url FROM pages WHERE {_N.format('html')} LIKE '%<h1>%tion%</h1>%'")(_matching("<h1>*tion*</h1>", "pages", ["page_id", "url"], "html"))


_PATTERNS = {"*Entió*?*rieRES*": ["entio", "rieres"], "ab*cd?ＡＢＣ": ["ab", "cd", "abc"], "the*Thé": ["the", "the"], "%a_b%": ["%a_b%"]}
_RUNS = ", ".join(f"('{p}', '{r}')" for p, runs in _PATTERNS.items() for r in runs)


@_query("required_grams", f"SELECT DISTINCT pattern, substr(run, CAST(i AS INTEGER), 3) AS gram FROM (SELECT pattern, run, unnest(range(1, length(run) - 1)) AS i FROM (VALUES {_RUNS}) AS t(pattern, run))")
def _(spark, sf):
    return spark.createDataFrame([(p, g) for p in _PATTERNS for g in compile_pattern(p).grams], "pattern string, gram string")


_GRAMS = f"SELECT DISTINCT doc_id, substr(t, i, 3) AS gram FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT doc_id, {_TEXT} AS t FROM documents) WHERE length(t) >= 3)"


def _text_grams(spark, sf):
    return gram_rows(_table(spark, sf, "documents").select("doc_id", normalized("text").alias("t")), "t", ["doc_id"])


@_query("trigram_postings", _GRAMS)
def _(spark, sf):
    return _text_grams(spark, sf)


@_query("gram_document_frequency", f"SELECT gram, count(*) AS n_docs FROM ({_GRAMS}) GROUP BY gram")
def _(spark, sf):
    # gram_rows gives each trigram once per document
    return _text_grams(spark, sf).groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs"))


@_query("flatten_json_strings", """
    SELECT conv_id, turn, 'body.text' AS path, strip_accents(lower(text)) AS value FROM conversations
    UNION ALL SELECT conv_id, turn, 'body.role[0]', strip_accents(lower(role)) FROM conversations""")
def _(spark, sf):
    c = _table(spark, sf, "conversations")
    j = F.to_json(F.struct(F.col("conv_id").alias("id"), F.struct(F.col("text"), F.array("role").alias("role")).alias("body")))
    return c.select("conv_id", "turn", flatten_fields(j).alias("f")).select("conv_id", "turn", F.explode("f").alias("path", "value"))


# prefilter, fields and verification


def _index(spark, sf, grams):
    d = stored(spark, sf)
    return index.postings(d, grams), index.field_masks(d)


def _has(gram: str) -> str:
    return "(" + " OR ".join(f"{c} LIKE '%{gram}%'" for c in ("ext_id", "lang", "source", "text")) + ")"


_PICK = ["ent", "rie"]
for _mode, _cond in (("and", " AND ".join(map(_has, _PICK))), ("or", " OR ".join(map(_has, _PICK))), ("not", "NOT (" + " OR ".join(map(_has, _PICK)) + ")")):
    _query(f"prefilter_{_mode}", f"WITH {_D} SELECT segment, doc_id FROM d WHERE {_cond}")(lambda spark, sf, m=_mode: index.prefilter(*_index(spark, sf, _PICK), _PICK, m))
    _query(f"prefilter_scan_{_mode}", f"WITH {_D} SELECT segment, doc_id FROM d WHERE {_cond}")(
        lambda spark, sf, m=_mode: search.candidates(stored(spark, sf), compile_pattern("ent*rie"), search.SearchOptions(paths=PATHS), m).select("segment", "doc_id")
    )


@_query("field_mask", f"WITH {_D} SELECT segment, doc_id FROM d WHERE ({_has('src')}) AND lang IS NOT NULL")
def _(spark, sf):
    return index.prefilter(*_index(spark, sf, ["src"]), ["src"], "and", "lang")


@_query("stored_postings", f"WITH {_D} SELECT segment, doc_id FROM d WHERE {_has('ent')} AND {_has('rie')}")
def _(spark, sf):
    d = stored(spark, sf)
    folder = shared_folder(spark)
    index.write_postings(index.postings(d), folder, 8)
    return index.prefilter(index.read_postings(spark, folder, _PICK), index.field_masks(d), _PICK)


@_query("field_mask_nulls", """
    SELECT d.doc_id, CASE WHEN q.quality IS NOT NULL THEN 'labelled' ELSE 'unlabelled' END AS kind FROM documents d
    LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON q.doc_id = d.doc_id""")
def _(spark, sf):
    # documents without a label have no field of that name
    labels = _table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = _table(spark, sf, "documents").join(labels, "doc_id", "left").withColumn("segment", F.lit("s"))
    d = documents.from_table(rows, {"_id": "doc_id", "quality": "quality"})
    with_it = search.candidates(d, compile_pattern("*", True), search.SearchOptions(field="quality"))
    without = d.join(index.field_masks(d).where("path = 'quality'").select("doc_id"), "doc_id", "left_anti")
    return with_it.select("doc_id", F.lit("labelled").alias("kind")).unionByName(without.select("doc_id", F.lit("unlabelled").alias("kind")))


@_query("weak_pattern", f"WITH {_D} SELECT segment, doc_id FROM d WHERE source LIKE '%s%'")
def _(spark, sf):
    o = search.SearchOptions(field="source", max_candidates=None, segment_hits=None, allow_weak=True, preview_mode="plain")
    return search.search(stored(spark, sf), "*s*", o).select("segment", "doc_id")


@_query("field_unknown_empty", f"WITH {_D} SELECT segment, doc_id FROM d WHERE false")
def _(spark, sf):
    return search.candidates(stored(spark, sf), compile_pattern("ent"), search.SearchOptions(field="no.such.field")).select("segment", "doc_id")


_FIRST = "CASE WHEN ext_id LIKE '%{0}%' THEN '_id' WHEN lang LIKE '%{0}%' THEN 'lang' WHEN source LIKE '%{0}%' THEN 'source' WHEN text LIKE '%{0}%' THEN 'text' END"


@_query("any_field_first_match", f"WITH {_D} SELECT segment, doc_id, {_FIRST.format('src')} AS matched_field FROM d WHERE {_FIRST.format('src')} IS NOT NULL")
def _(spark, sf):
    p = compile_pattern("src")
    d = stored(spark, sf)
    return d.select("segment", "doc_id", search.matched_field(F.col("fields"), p, paths=PATHS).alias("matched_field")).where("matched_field IS NOT NULL")


@_query("hits_by_field", f"WITH {_D} SELECT matched_field, count(*) AS hits FROM (SELECT {_FIRST.format('111')} AS matched_field FROM d) WHERE matched_field IS NOT NULL GROUP BY matched_field")
def _(spark, sf):
    return search.stats(stored(spark, sf), "*111*", search.SearchOptions(paths=PATHS)).where("matched_field IS NOT NULL").select("matched_field", "hits")


@_query("verify_precision", f"WITH {_D} SELECT count(*) AS candidates, count(CASE WHEN text LIKE '%ent%rie%' OR lang LIKE '%ent%rie%' OR source LIKE '%ent%rie%' OR ext_id LIKE '%ent%rie%' THEN 1 END) AS hits FROM d WHERE {_has('ent')} AND {_has('rie')}")
def _(spark, sf):
    return search.stats(stored(spark, sf), "*ent*rie*", search.SearchOptions(paths=PATHS)).where("matched_field IS NULL").select("candidates", "hits")


# previews



@_query("preview_truncate", f"SELECT doc_id, CASE WHEN length({_TEXT}) > 180 THEN substr({_TEXT}, 1, 180) || '…' ELSE {_TEXT} END AS preview FROM documents")
def _(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", normalized("text").alias("t")).select("doc_id", truncated(F.col("t")).alias("preview"))


@_query("preview_literal", f"""
    WITH a AS (SELECT doc_id, {_TEXT} AS t FROM documents), b AS (SELECT doc_id, t, strpos(t, 'ention') AS pos FROM a WHERE t LIKE '%ention%'),
    c AS (SELECT doc_id, t, pos, greatest(1, pos - 86) AS lo, least(length(t), pos + 5 + 86) AS hi FROM b),
    e AS (SELECT doc_id, CASE WHEN lo > 1 THEN '…' ELSE '' END || substr(t, lo, pos - lo) || '[ention]' || substr(t, pos + 6, hi - pos - 5) || CASE WHEN hi < length(t) THEN '…' ELSE '' END AS s FROM c)
    SELECT doc_id, CASE WHEN length(s) > 184 THEN substr(s, 1, 184) || '…' ELSE s END AS preview FROM e""")
def _(spark, sf):
    t = _table(spark, sf, "documents").select("doc_id", normalized("text").alias("t")).where(F.col("t").contains("ention"))
    return t.select("doc_id", literal_preview(F.col("t"), "ention").alias("preview"))


@_query("preview_needle", f"""
    WITH a AS (SELECT doc_id, {_TEXT} AS t FROM documents), b AS (SELECT doc_id, t, strpos(t, 'ention') AS pos FROM a WHERE t LIKE '%ention%'),
    c AS (SELECT doc_id, t, pos, greatest(1, pos - 86) AS lo, least(length(t), pos + 5 + 86) AS hi FROM b),
    e AS (SELECT doc_id, CASE WHEN lo > 1 THEN '…' ELSE '' END || substr(t, lo, pos - lo) || '[ention]' || substr(t, pos + 6, hi - pos - 5) || CASE WHEN hi < length(t) THEN '…' ELSE '' END AS s FROM c)
    SELECT doc_id, CASE WHEN length(s) > 184 THEN substr(s, 1, 184) || '…' ELSE s END AS preview FROM e""")
def _(spark, sf):
    # the longest run is the needle; where it doesn't occur, its longest prefix that does is marked
    t = _table(spark, sf, "documents").select("doc_id", normalized("text").alias("t")).where(F.col("t").contains("ention"))
    return t.select("doc_id", preview(F.col("t"), compile_pattern("*the*ention☃qx*"), "literal").alias("preview"))


@_query("preview_span", f"""
    WITH a AS (SELECT doc_id, '[' || {_TEXT} || ']' AS s FROM documents WHERE {_TEXT} LIKE '%ention%')
    SELECT doc_id, CASE WHEN length(s) > 184 THEN substr(s, 1, 184) || '…' ELSE s END AS preview FROM a""")
def _(spark, sf):
    p = compile_pattern("*ention*")
    t = _table(spark, sf, "documents").select("doc_id", normalized("text").alias("t")).where(p.matches(F.col("t")))
    return t.select("doc_id", span_preview(F.col("t"), p).alias("preview"))


# hits, pages, dedup

_HIT = "shard, gen, ord, segment, doc_id, ext_id, matched_field"
_HITS = f"h AS (SELECT shard, gen, ord, segment, doc_id, ext_id, 'text' AS matched_field, gid, text FROM d WHERE text LIKE '%ention%')"


def _hits(spark, sf, **options):
    o = search.SearchOptions(**({"field": "text", "max_candidates": None, "segment_hits": None, "preview_mode": "plain"} | options))
    return search.search(stored(spark, sf), "*ention*", o)


@_query("search_all_hits", f"WITH {_D}, {_HITS} SELECT {_HIT}, CASE WHEN length(text) > 180 THEN substr(text, 1, 180) || '…' ELSE text END AS preview FROM h")
def _(spark, sf):
    return _hits(spark, sf)


@_query("search_page", f"WITH {_D}, {_HITS} SELECT {_HIT} FROM h ORDER BY {_ORDER} LIMIT 20")
def _(spark, sf):
    return search.page(search.dedup(_hits(spark, sf)), 20).drop("preview")


@_query("cursor_page2", f"WITH {_D}, {_HITS} SELECT {_HIT} FROM h WHERE NOT (segment = 'seg-0' AND doc_id <= 40) AND NOT (segment = 'seg-4' AND doc_id <= 7) ORDER BY {_ORDER} LIMIT 20")
def _(spark, sf):
    return search.page(search.dedup(_hits(spark, sf)), 20, {"seg-0": 40, "seg-4": 7}).drop("preview")


@_query("next_cursor", f"""
    WITH {_D}, {_HITS}, r AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS n FROM h)
    SELECT segment, CAST(max(doc_id) AS BIGINT) AS last_docid FROM r WHERE n <= 20 GROUP BY segment""")
def _(spark, sf):
    ranked = search.dedup(_hits(spark, sf))
    return search.next_cursor(ranked, search.page(ranked, 20))


@_query("max_candidates", f"""
    WITH {_D}, c AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY doc_id) AS n FROM d
        WHERE {" AND ".join(_has(g) for g in ("ent", "nti", "tio", "ion"))})
    SELECT {_HIT} FROM (SELECT *, 'text' AS matched_field FROM c WHERE n <= 10 AND text LIKE '%ention%')""")
def _(spark, sf):
    return _hits(spark, sf, max_candidates=10, paths=PATHS).drop("preview")


@_query("segment_hit_cap", f"WITH {_D}, {_HITS} SELECT {_HIT} FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY doc_id) AS n FROM h) WHERE n <= 3")
def _(spark, sf):
    return _hits(spark, sf, segment_hits=3).drop("preview")


_DUP = f"r AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY {_ORDER}) AS rank FROM h)"


def _by_content(spark, sf):
    d = stored(spark, sf).withColumn("ext_id", F.md5(F.col("fields")["text"]))
    return search.dedup(search.search(d, "*ention*", search.SearchOptions(field="text", max_candidates=None, segment_hits=None, preview_mode="plain")))


@_query("dedup_first_wins", f"WITH {_D}, {_HITS}, {_DUP} SELECT segment, doc_id, md5(text) AS ext_id FROM r WHERE rank = 1")
def _(spark, sf):
    return _by_content(spark, sf).where("rank = 1").select("segment", "doc_id", "ext_id")


@_query("dedup_dropped", f"WITH {_D}, {_HITS}, {_DUP} SELECT count(CASE WHEN rank > 1 THEN 1 END) AS dedup_dropped FROM r")
def _(spark, sf):
    return _by_content(spark, sf).agg(F.count(F.when(F.col("rank") > 1, 1)).alias("dedup_dropped"))


@_query("search_offset", f"WITH {_D}, {_HITS} SELECT {_HIT} FROM h ORDER BY {_ORDER} LIMIT 15 OFFSET 25")
def _(spark, sf):
    return _hits(spark, sf).orderBy(*search.order_columns()).offset(25).limit(15).drop("preview")


@_query("metric_totals", f"""
    WITH {_D}, {_HITS}, {_DUP}, s AS (SELECT segment, count(*) AS hits, count(CASE WHEN rank > 1 THEN 1 END) AS dropped FROM r GROUP BY segment)
    SELECT count(*) AS segments, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(dropped) AS BIGINT) AS dedup_dropped FROM s""")
def _(spark, sf):
    per = _by_content(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("hits"), F.count(F.when(F.col("rank") > 1, 1)).alias("dropped"))
    return per.agg(F.count(F.lit(1)).alias("segments"), F.sum("hits").alias("hits"), F.sum("dropped").alias("dedup_dropped"))


@_query("checksums", f"WITH {_D} SELECT segment, count(*) AS n_docs, true AS same FROM d GROUP BY segment")
def _(spark, sf):
    """Each segment's hash of contents, of what was written and of what is read back from one file of all."""
    d = stored(spark, sf)
    folder = shared_folder(spark)
    d.select("segment", "doc_id", "ext_id", "fields").write.option("parquet.page.write-checksum.enabled", "true").parquet(folder)
    back = spark.read.option("parquet.page.verify-checksum.enabled", "true").parquet(folder)
    was, now = documents.content_hash(d), documents.content_hash(back).select("segment", F.col("content_hash").alias("now"))
    return was.join(now, "segment").select("segment", "n_docs", (F.col("content_hash") == F.col("now")).alias("same"))


@_query("get_docs", f"WITH {_D} SELECT segment, doc_id, ext_id, text FROM d WHERE (segment = 'seg-1' AND doc_id IN (3, 99)) OR (segment = 'seg-7' AND doc_id = 0)")
def _(spark, sf):
    found = documents.get_docs(stored(spark, sf), [("seg-1", 3), ("seg-1", 99), ("seg-7", 0), ("seg-7", 1000)])
    return found.select("segment", "doc_id", "ext_id", F.col("fields")["text"].alias("text"))


# manifest


_FLAT = json.dumps({"shards": {"0": 1, "2": 2}, "segments": {"0:1": ["seg-0"], "2:2": ["seg-2"]}})


def _of_manifest(spark, sf, shards, pinned=None):
    m = Manifest(spark, shared_folder(spark))
    m.migrate(_FLAT)
    m.append(2, ["seg-6"], expected_gen=2)
    rows, _ = m.resolve(shards, pinned)
    segments = spark.createDataFrame([(p,) for _, _, _, p in rows], "segment string")
    return _hits(spark, sf).join(F.broadcast(segments), "segment", "left_semi").select("segment", "doc_id")


@_query("manifest_current", f"WITH {_D}, {_HITS} SELECT segment, doc_id FROM h WHERE segment IN ('seg-0', 'seg-2', 'seg-6')")
def _(spark, sf):
    return _of_manifest(spark, sf, [0, 2])


@_query("manifest_pinned", f"WITH {_D}, {_HITS} SELECT segment, doc_id FROM h WHERE segment IN ('seg-0', 'seg-2')")
def _(spark, sf):
    return _of_manifest(spark, sf, [0, 2, 9], {2: 2})


@_query("manifest_get", "SELECT CAST(2 AS BIGINT) AS shard, CAST(3 AS BIGINT) AS gen, unnest(['seg-2', 'seg-6']) AS segment UNION ALL SELECT 2, 2, 'seg-2'")
def _(spark, sf):
    m = Manifest(spark, shared_folder(spark))
    m.migrate(_FLAT)
    m.append(2, ["seg-6"])
    found = [m.get(2), m.get(2, 2)]
    return spark.createDataFrame([(x["shard"], x["gen"], p) for x in found for p in x["segments"]], "shard long, gen long, segment string")


@_query("manifest_cas", "SELECT * FROM (VALUES ('first', true), ('second', false), ('retry', true)) AS t(writer, won)")
def _(spark, sf):
    m = Manifest(spark, shared_folder(spark))

    def tried(expected: int) -> bool:
        try:
            m.append(0, [f"seg-{expected}"], expected_gen=expected)
            return True
        except ManifestConflict:
            return False

    return spark.createDataFrame([("first", tried(0)), ("second", tried(0)), ("retry", tried(1))], "writer string, won boolean")


@_query("search_by_shard", f"WITH {_D}, {_HITS} SELECT segment, doc_id FROM h WHERE shard = 2")
def _(spark, sf):
    return search.search(stored(spark, sf).where("shard = 2"), "*ention*", search.SearchOptions(field="text", max_candidates=None, segment_hits=None, preview_mode="plain")).select("segment", "doc_id")


# hot documents, segments and ingest


_ITEMS = "i AS (SELECT CAST(item_id AS VARCHAR) AS ext_id, {0} AS body, row_number() OVER (ORDER BY item_id) AS n, count(*) OVER () AS total FROM benchmark)".format(_TEXT)


def _items(spark, sf) -> list[list[dict]]:
    """The items of the benchmark, which is small, in batches of ten."""
    rows = _table(spark, sf, "benchmark").select("item_id", "text").orderBy("item_id").toLocalIterator()
    docs = [{"_id": str(r.item_id), "text": {"body": r.text}} for r in rows]
    return [docs[k : k + 10] for k in range(0, len(docs), 10)]


def _pages(spark, engine: Engine, **request) -> DataFrame:
    """ext_id and matched_field of all hits, page after page; what pages had is written, so only some of them are held."""
    schema, folder = "ext_id string, matched_field string", f"{shared_folder(spark)}/pages"
    found, cursor = [], {}
    while True:
        page = engine.search(SearchRequest(cursor=cursor, **request))
        cursor = page["cursor"]
        found += [(h["ext_id"], h["matched_field"]) for h in page["hits"]]
        last = len(page["hits"]) < request["size"]
        if last or len(found) >= 50_000:
            spark.createDataFrame(found, schema).coalesce(1).write.mode("append").parquet(folder)
            found = []
        if last:
            return spark.read.schema(schema).parquet(folder)


@_query("search_pages", f"WITH {_D} SELECT ext_id, 'text' AS matched_field FROM d WHERE text LIKE '%ention%'")
def _(spark, sf):
    """Pages of an engine over segments of which each look sees fewer hits than there are."""
    engine = Engine(spark, Config(root=shared_folder(spark)))
    d = documents.from_table(_table(spark, sf, "documents"), {"_id": "doc_id", "lang": "lang", "source": "source", "text": "text"})
    paths = [f"{engine.config.root}/made/{k}" for k in range(2)]
    for k, path in enumerate(paths):
        documents.write_segment(d.where(F.col("doc_id") % 2 == k), path, ["doc_id"])
    engine.manifests.append(0, paths)
    return _pages(spark, engine, wildcard="*ention*", size=120, segment_hits=100)


@_query("hot_union", f"WITH {_ITEMS} SELECT ext_id, 'text.body' AS matched_field FROM i WHERE body LIKE '%ent%'")
def _(spark, sf):
    """Pages over documents of which half are in a segment and half are hot; between two pages all are committed."""
    engine = Engine(spark, Config(root=shared_folder(spark)))
    batches = _items(spark, sf)
    for k, batch in enumerate(batches):
        if k == len(batches) // 2:
            engine.ingestor.drain()
        engine.ingest(batch, key=f"batch-{k}")
    first = engine.search(SearchRequest("*ent*", field="text.body", size=3))
    engine.ingestor.drain()
    rest = engine.search(SearchRequest("*ent*", field="text.body", size=10_000, cursor=first["cursor"]))
    return spark.createDataFrame([(h["ext_id"], h["matched_field"]) for h in first["hits"] + rest["hits"]], "ext_id string, matched_field string")


@_query("hot_cap", f"WITH {_ITEMS} SELECT ext_id FROM i WHERE n > least(30, total) - 25 AND n <= 30")
def _(spark, sf):
    """The newest 25 of the documents that landed before the cap was met."""
    ingestor = Ingestor(spark, shared_folder(spark), hot_cap=25)
    for batch in _items(spark, sf):
        try:
            ingestor.submit(batch)
        except Backpressure:
            break
    return ingestor.hot().select("ext_id")


@_query("backpressure", f"WITH {_ITEMS} SELECT (n - 1) // 10 AS batch, bool_or(n <= 30) AS taken FROM i GROUP BY 1")
def _(spark, sf):
    ingestor = Ingestor(spark, shared_folder(spark), hot_cap=25)

    def taken(batch: list[dict]) -> bool:
        try:
            return ingestor.submit(batch, key=batch[0]["_id"])["ok"]
        except Backpressure:
            return False

    return spark.createDataFrame([(k, taken(b)) for k, b in enumerate(_items(spark, sf))], "batch long, taken boolean")


@_query("damaged_batches", f"WITH {_ITEMS} SELECT ext_id, body FROM i WHERE (n - 1) // 10 <> 1")
def _(spark, sf):
    """What is committed when the second batch isn't as its checksum says."""
    ingestor = Ingestor(spark, shared_folder(spark))
    names = [ingestor.submit(b)["batch"] for b in _items(spark, sf)]
    if len(names) > 1:
        ingestor.files.replace(f"batches/{names[1]}", '{"_id": "forged"}\n')
    ingestor.drain()
    found, _ = ingestor.manifest.resolve()
    return documents.open_segments(spark, found).select("ext_id", F.col("fields")["text.body"].alias("body"))


@_query("segment_errors", f"WITH {_D} SELECT ext_id, 'text' AS matched_field FROM d WHERE text LIKE '%ention%'")
def _(spark, sf):
    """A manifest names a segment that isn't there, and the engine passes it by."""
    engine = Engine(spark, Config(root=shared_folder(spark), on_segment_error="skip"))
    d = documents.from_table(_table(spark, sf, "documents"), {"_id": "doc_id", "lang": "lang", "source": "source", "text": "text"})
    path = f"{engine.config.root}/made"
    documents.write_segment(d, path, ["doc_id"])
    engine.manifests.append(0, [f"{path}-missing", path])
    return _pages(spark, engine, wildcard="*ention*", size=5000)


@_query("segment_roundtrip", f"WITH {_D} SELECT CAST(gid AS INTEGER) AS doc_id, ext_id, text FROM d WHERE text LIKE '%ention%'")
def _(spark, sf):
    path = f"{shared_folder(spark)}/segment"
    d = documents.from_table(_table(spark, sf, "documents"), {"_id": "doc_id", "lang": "lang", "source": "source", "text": "text"})
    d = d.withColumn("fields", F.map_concat("fields", F.create_map(F.lit("gid"), F.col("doc_id").cast("string"))))
    documents.write_segment(d, path, ["doc_id"])
    out = documents.open_segments(spark, [(0, 1, 0, path)])
    p = compile_pattern("*ention*")
    return out.where(p.matches(F.col("fields")["text"])).select(F.col("fields")["gid"].cast("int").alias("doc_id"), "ext_id", F.col("fields")["text"].alias("text"))


@_query("ingest_stream", f"SELECT CAST(item_id AS VARCHAR) AS ext_id, {_TEXT} AS body FROM benchmark")
def _(spark, sf):
    ingestor = Ingestor(spark, shared_folder(spark))
    for k, batch in enumerate(_items(spark, sf)):
        ingestor.submit(batch, key=f"batch-{k}")
        ingestor.submit(batch, key=f"batch-{k}")
    ingestor.drain()
    found, _ = ingestor.manifest.resolve()
    return documents.open_segments(spark, found).select("ext_id", F.col("fields")["text.body"].alias("body"))


def _jsonl(spark, sf) -> str:
    """The documents as JSON lines: _id, lang and a nested text."""
    folder = f"{shared_folder(spark)}/lines"
    d = _table(spark, sf, "documents")
    row = F.struct(F.col("doc_id").cast("string").alias("_id"), F.col("doc_id").alias("n"), F.col("lang"), F.struct(F.col("text").alias("body")).alias("text"))
    d.select(F.to_json(row).alias("value")).write.text(folder)
    return folder


@_query("jsonl_scan", f"SELECT CAST(doc_id AS VARCHAR) AS ext_id, {_N.format('lang')} AS lang, {_TEXT} AS body FROM documents")
def _(spark, sf):
    f = F.col("fields")
    return documents.read_jsonl(spark, _jsonl(spark, sf), strict_id=True).select("ext_id", f["lang"].alias("lang"), f["text.body"].alias("body"))


_SEGMENT_HITS = f"SELECT CAST(doc_id AS VARCHAR) AS ext_id, 'text.body' AS matched_field FROM documents WHERE {_TEXT} LIKE '%{{}}%'"


@_query("indexed_segment", _SEGMENT_HITS.format("ention%rie"))
def _(spark, sf):
    """A segment that is built with its index, checked against its catalog and searched by way of both."""
    engine = Engine(spark, Config(root=shared_folder(spark)))
    path = engine.build_segment(_jsonl(spark, sf), f"{engine.config.root}/made", postings=True)
    engine.verify_segment(path)
    return engine.search_segment(path, "*ention*rie*", limit=1_000_000).select("ext_id", "matched_field")


@_query("legacy_segment", _SEGMENT_HITS.format("ention"))
def _(spark, sf):
    """A segment of the older layout, whose format is found out."""
    engine = Engine(spark, Config(root=shared_folder(spark)))
    d = documents.from_table(_table(spark, sf, "documents"), {"text.body": "text"}, F.col("doc_id").cast("string"))
    d.select(F.col("doc_id").cast("int").alias("doc_id"), "ext_id", "fields").write.json(f"{engine.config.root}/old/docs.jsonl")
    return engine.search_segment(f"{engine.config.root}/old", "*ention*", limit=1_000_000).select("ext_id", "matched_field")


@_query("preferred_preview", f"""
    WITH p AS (SELECT doc_id, CASE WHEN {_TEXT} <> '' AND doc_id % 2 = 0 THEN {_TEXT} ELSE {_N.format('lang')} END AS v FROM documents)
    SELECT doc_id, CASE WHEN length(v) > 60 THEN substr(v, 1, 60) || '…' ELSE v END AS preview FROM p""")
def _(spark, sf):
    """What is shown of a document that has a body, and of one that has only other fields: the first of them by name."""
    d = _table(spark, sf, "documents").withColumn("body", F.when(F.col("doc_id") % 2 == 0, F.col("text")))
    f = F.col("fields")
    d = documents.from_table(d, {"lang": "lang", "source": "source", "text.body": "body"}, F.lit(""))
    return d.select("doc_id", preview(f[label_field(f)], compile_pattern("*", True), "plain", 60).alias("preview"))
