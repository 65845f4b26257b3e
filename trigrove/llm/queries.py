"""The queries of this package, over whole tables and with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm import chat, compression, containment, decontam, lines, packing, secrets, substrings, token_counts, warc
from trigrove.llm.common import cut, shared_dir, sifted, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 4).alias("score"), "question_hits", "question_grams", "answer_hits", "answer_words")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # first_doc and first_word tell paths apart; the hash that names one is left out
    return substrings.repeated_spans(table(spark, sf_dir, "documents")).drop("path")


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_scores(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_chats(table(spark, sf_dir, "conversations"))
    spans = F.concat_ws(",", F.transform("learned_spans", lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string"))))
    return out.select("conv_id", "n_turns", "n_bytes", "learned_bytes", spans.alias("learned_spans"), "has_marker", "text")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.near_classes(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.word_counts(table(spark, sf_dir, "documents")))


def op8_token_rollup(spark: SparkSession, sf_dir: str, tokenizers: str = token_counts.TOKENIZERS) -> DataFrame:
    """Inserts all documents, deletes the toxic ones, and revises those of low quality, whose numbers become a single 0.
    Deletes and revisions come twice."""
    versions = {"words-1": None, "byte_bpe_50k-1": (f"{tokenizers}/byte_bpe_50k.tiktoken", token_counts.PATTERN)}
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counted = cut(token_counts.count_tokens(docs, versions))
    toxic = labels.where("toxic = 1").select("doc_id")
    poor = labels.where("quality = 0 AND toxic = 0").select("doc_id").join(toxic, "doc_id", "left_anti")
    # texts aren't shuffled: those that may be poor are counted where they are, and only counts are joined
    revised = token_counts.count_tokens(sifted(docs, "doc_id", poor).withColumn("text", F.regexp_replace("text", "[0-9]+", "0")), versions).join(poor, "doc_id", "left_semi")
    changes = {
        "inserts": token_counts.signed(counted, 1),
        "deletes": token_counts.signed(counted.join(toxic, "doc_id", "left_semi"), -1),
        "revisions": token_counts.signed(counted.join(poor, "doc_id", "left_semi"), -1).unionByName(token_counts.signed(revised, 1)),
    }
    rollup = token_counts.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for name in ("inserts", "deletes", "revisions", "deletes", "revisions"):
        rollup.apply(name, changes[name])
    return rollup.totals()


def op9_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.assemble_captures(warc.read_warc(warc.pages_as_warc(table(spark, sf_dir, "pages"))))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.keep_bitmaps(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_secret_scan, op3_substring_dedup, op4_compression_bands, op5_chat_format, op6_near_duplicates, op7_packing, op8_token_rollup, op9_warc_captures, op10_line_dedup)
}

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _secret_sql() -> str:
    """Runs of each class by regular expressions, without leading words; all their windows, and the entropy of each from the counts of its characters."""
    kinds, found = [], []
    allow = "|".join(f"(?:{p})" for p in secrets.ALLOWED).replace("'", "''")
    for k, c in enumerate(secrets.CLASSES):
        chars = "".join("\\" + x if x in "-/+" else x for x in c.chars)
        rx = f"[{chars}]{{{c.window},}}" + ("={0,2}" if c.pad else "")
        kinds.append(f"SELECT doc_id, text, {k} AS k, '{c.name}' AS char_class, {c.window} AS w, CAST({c.bits} AS DOUBLE) AS bits, regexp_extract_all(text, '{rx}') AS rs, regexp_split_to_array(text, '{rx}') AS gaps FROM documents WHERE regexp_matches(text, '{rx}')")
        before = " AND ".join(f"NOT EXISTS (SELECT 1 FROM f{j} WHERE f{j}.doc_id = g.doc_id AND f{j}.start < g.start + g.length AND g.start < f{j}.start + f{j}.length)" for j in range(k)) or "true"
        found.append(f"f{k} AS (SELECT g.* FROM good g WHERE g.k = {k} AND {before})")
    return f"""
        WITH c AS ({" UNION ALL ".join(kinds)}),
        q AS (SELECT doc_id, k, char_class, w, bits, unnest(rs) AS whole, unnest(range(len(rs))) AS i FROM c),
        l AS (SELECT *, length(regexp_extract(whole, '^{secrets.LEAD}')) AS lead FROM q),
        r AS (SELECT *, substr(regexp_replace(whole, '=+$', ''), CAST(lead AS INTEGER) + 1) AS run FROM l WHERE length(regexp_replace(whole, '=+$', '')) - lead >= w),
        s AS (SELECT doc_id, k, unnest(range(len(rs))) AS i, unnest([length(array_to_string(list_slice(gaps, 1, j + 1), '')) + length(array_to_string(list_slice(rs, 1, j), '')) for j in range(len(rs))]) AS start FROM c),
        w AS (SELECT doc_id, k, i, w, run, unnest(range(length(run) - w + 1)) AS j FROM r),
        x AS (SELECT doc_id, k, i, w, j, unnest(string_split(substr(run, CAST(j AS INTEGER) + 1, w), '')) AS ch FROM w),
        n AS (SELECT doc_id, k, i, w, j, ch, count(*) AS m FROM x GROUP BY ALL),
        h AS (SELECT doc_id, k, i, j, log2(w) - sum(m * log2(m)) / w AS h FROM n GROUP BY doc_id, k, i, w, j),
        t AS (SELECT doc_id, k, i, max(h) AS h FROM h GROUP BY doc_id, k, i),
        good AS (SELECT r.doc_id, r.k, r.char_class, CAST(s.start + lead AS INTEGER) AS start, CAST(length(whole) - lead AS INTEGER) AS length, CAST(floor(h * 1000 + 0.5 + 1e-6) AS INTEGER) AS millibits, substr(run, 1, 4) || '...' AS preview
            FROM r JOIN t ON r.doc_id = t.doc_id AND r.k = t.k AND r.i = t.i JOIN s ON r.doc_id = s.doc_id AND r.k = s.k AND r.i = s.i
            WHERE h >= bits - 1e-9 AND NOT regexp_full_match(run, '{allow}')),
        {", ".join(found)}
        SELECT doc_id, char_class, start, length, millibits, preview FROM ({" UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(len(secrets.CLASSES)))})"""


ORACLE_SQL: dict[str, str] = {
    # BM25 of all passages against all segments, without an index, and the overlap rule around those that reach the threshold
    "op1_decontamination": f"""
        WITH b AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        bw AS (SELECT row_number() OVER (ORDER BY item_id, text) AS k, item_id, {_WORDS.format("text")} AS ws, len({_WORDS.format("regexp_extract(rtrim(text, ' ' || chr(10)), '(?s)^(?:.*[.?!][ ' || chr(10) || '])?(.*)$', 1)")}) AS last FROM b),
        p AS (SELECT k, item_id, ws, len(ws) AS n, len(ws) - CASE WHEN len(ws) - last < 3 THEN greatest(least(5, len(ws) // 2), CASE WHEN len(ws) > 1 THEN 1 ELSE 0 END) ELSE greatest(last, least(5, len(ws) // 2), CASE WHEN len(ws) > 1 THEN 1 ELSE 0 END) END AS q FROM bw WHERE len(ws) > 0),
        sa AS (SELECT k, ws, n, unnest(CASE WHEN n <= 64 THEN [0] ELSE list_append([i * 64 FOR i IN range((n - 65) // 64 + 1)], n - 64) END) AS a FROM p),
        sg AS (SELECT row_number() OVER (ORDER BY k, a) AS seg, k, least(64, n) AS len, list_slice(ws, CAST(a AS INTEGER) + 1, CAST(a AS INTEGER) + 64) AS sw FROM sa),
        tf AS (SELECT seg, k, len, w, count(*) AS tf FROM (SELECT seg, k, len, unnest(sw) AS w FROM sg) GROUP BY ALL),
        df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
        m AS (SELECT count(*) AS n, avg(len) AS mean FROM sg),
        c AS (SELECT seg, k, tf.w, ln(1 + (m.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS c FROM tf JOIN df ON tf.w = df.w CROSS JOIN m),
        part AS (SELECT seg, k, w, c / sum(c) OVER (PARTITION BY seg) AS c FROM c),
        d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents WHERE text IS NOT NULL),
        ps AS (SELECT doc_id, ws, unnest(range((len(ws) + 63) // 64)) AS i FROM d WHERE len(ws) > 0),
        pw AS (SELECT DISTINCT doc_id, i, unnest(list_slice(ws, CAST(i AS INTEGER) * 64 + 1, CAST(i AS INTEGER) * 64 + 128)) AS w FROM ps),
        sc AS (SELECT doc_id, i, seg, k, sum(c) AS score FROM pw JOIN part USING (w) GROUP BY doc_id, i, seg, k HAVING sum(c) >= 0.5 - 1e-9),
        hit AS (SELECT doc_id, k, i, max(score) AS score FROM sc GROUP BY doc_id, k, i),
        win AS (SELECT hit.*, p.item_id, p.ws AS iw, p.q, list_slice(d.ws, CAST(greatest(0, i * 64 - greatest(128, p.n)) AS INTEGER) + 1, CAST(i * 64 + 128 + greatest(128, p.n) AS INTEGER)) AS dw, CAST(least(3, greatest(1, p.q)) AS INTEGER) AS g FROM hit JOIN p ON p.k = hit.k JOIN d ON d.doc_id = hit.doc_id),
        gr AS (SELECT *, list_distinct([array_to_string(list_slice(iw, CAST(j AS INTEGER), CAST(j AS INTEGER) + g - 1), ' ') FOR j IN range(1, q - g + 2)]) AS ig, [array_to_string(list_slice(dw, CAST(j AS INTEGER), CAST(j AS INTEGER) + g - 1), ' ') FOR j IN range(1, len(dw) - g + 2)] AS dg, list_distinct(list_slice(iw, CAST(q AS INTEGER) + 1, CAST(len(iw) AS INTEGER))) AS ans FROM win),
        v AS (SELECT doc_id, item_id, k, score, len(list_intersect(ig, dg)) AS qh, len(ig) AS qn, len(list_intersect(ans, dw)) AS ah, len(ans) AS an FROM gr),
        best AS (SELECT doc_id, k, max(CASE WHEN qh >= 0.4 * qn AND ah >= 0.5 * an THEN qh * 1000000 + ah END) AS best, max(score) AS score FROM v GROUP BY doc_id, k)
        SELECT DISTINCT v.doc_id, v.item_id, round(best.score, 4) AS score, CAST(qh AS INTEGER) AS question_hits, CAST(qn AS INTEGER) AS question_grams, CAST(ah AS INTEGER) AS answer_hits, CAST(an AS INTEGER) AS answer_words
        FROM best JOIN v ON v.doc_id = best.doc_id AND v.k = best.k AND v.qh * 1000000 + v.ah = best.best AND qh >= 0.4 * qn AND ah >= 0.5 * an""",
    "op2_secret_scan": _secret_sql(),
    # every run of 50 words, and the links between those that repeat
    "op3_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS pos FROM w WHERE len(ws) >= 50),
        k AS (SELECT doc_id, pos, md5(array_to_string(list_slice(ws, pos, pos + 49), ' ')) AS h FROM p),
        c AS (SELECT *, count(*) OVER (PARTITION BY h) AS copies FROM k),
        l AS (SELECT *, CASE WHEN lead(pos) OVER d = pos + 1 THEN lead(h) OVER d END AS nxt, lead(copies) OVER d AS next_copies FROM c WHERE copies > 1 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
        s AS (SELECT *, nxt IS NOT NULL AND next_copies = copies AND count(*) OVER (PARTITION BY h, nxt) = copies AS single FROM l),
        e AS (SELECT *, CASE WHEN coalesce(lag(single) OVER (PARTITION BY doc_id ORDER BY pos), false) THEN 0 ELSE 1 END AS head FROM s),
        g AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chain FROM e),
        r AS (SELECT doc_id, min(pos) - 1 AS start, count(*) + 49 AS n, min(copies) AS copies, min(CASE WHEN head = 1 THEN h END) AS h FROM g GROUP BY doc_id, chain),
        f AS (SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(start) OVER o AS first_start, max(doc_id) OVER (PARTITION BY h) AS last_doc FROM r WINDOW o AS (PARTITION BY h ORDER BY doc_id, start))
        SELECT doc_id, CAST(start AS INTEGER) AS start_word, CAST(n AS INTEGER) AS n_words, copies, first_doc, CAST(first_start AS INTEGER) AS first_word, doc_id = first_doc AND start = first_start AS is_first, first_doc < last_doc AS across FROM f""",
    # all links by their shared shingles; the search is approximate, it finds all of them in these documents
    "op6_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 3 THEN ws[CAST(i AS INTEGER)] || ' ' || ws[CAST(i AS INTEGER) + 1] || ' ' || ws[CAST(i AS INTEGER) + 2] ELSE array_to_string(ws, ' ') END AS g
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
        s AS (SELECT doc_id, count(*) AS size, md5(string_agg(g, '|' ORDER BY g)) AS h FROM g GROUP BY doc_id),
        f AS (SELECT doc_id, size, min(doc_id) OVER (PARTITION BY h) AS rep, count(*) OVER (PARTITION BY h) AS n_copies FROM s),
        r AS (SELECT * FROM f WHERE doc_id = rep),
        rg AS (SELECT g.doc_id, g.g FROM g JOIN r ON r.doc_id = g.doc_id),
        u AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM rg x JOIN rg y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
        l AS (SELECT a, b, p.size AS size_a, q.size AS size_b FROM u JOIN r p ON p.doc_id = a JOIN r q ON q.doc_id = b WHERE shared >= 0.7 * least(p.size, q.size) - 1e-9),
        n AS (SELECT a, count(*) AS n_links, count(CASE WHEN size_b > 2 * size_a THEN 1 END) AS n_holders FROM l GROUP BY a),
        e AS (SELECT a, b FROM l WHERE greatest(size_a, size_b) <= 2 * least(size_a, size_b)),
        c(doc_id, label) AS (SELECT doc_id, doc_id FROM r UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.doc_id),
        k AS (SELECT doc_id, min(label) AS label FROM c GROUP BY doc_id)
        SELECT f.doc_id, k.label AS class_id, f.n_copies, coalesce(n.n_links, 0) AS n_links, coalesce(n.n_holders, 0) AS n_holders
        FROM f JOIN k ON k.doc_id = f.rep LEFT JOIN n ON n.a = f.rep WHERE f.n_copies > 1 OR n.n_links > 0""",
    "op5_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                   '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS segment
            FROM conversations WHERE conv_id IS NOT NULL),
        u AS (
            SELECT *, sum(octet_length(encode(segment))) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS ends
            FROM t)
        SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, CAST(sum(octet_length(encode(segment))) AS BIGINT) AS n_bytes,
               CAST(sum(CASE WHEN role = 'assistant' THEN octet_length(encode(text)) ELSE 0 END) AS BIGINT) AS learned_bytes,
               coalesce(string_agg(CASE WHEN role = 'assistant' THEN CAST(CAST(ends AS BIGINT) - 11 - octet_length(encode(text)) AS VARCHAR) || '-' || CAST(CAST(ends AS BIGINT) - 11 AS VARCHAR) END, ',' ORDER BY ends), '') AS learned_spans,
               bool_or(contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR contains(role, '<|im_start|>') OR contains(role, '<|im_end|>')) AS has_marker,
               string_agg(segment, '' ORDER BY turn NULLS FIRST, role, text) AS text
        FROM u GROUP BY conv_id""",
    "op10_line_dedup": """
        WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
        k AS (SELECT doc_id, pos, length(line) < 20 OR row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 AS keep FROM l),
        e AS (SELECT *, CASE WHEN keep = lag(keep) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM k),
        r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM e),
        g AS (SELECT doc_id, run, keep, count(*) AS n FROM r GROUP BY doc_id, run, keep)
        SELECT doc_id, CAST(sum(n) AS INTEGER) AS n_lines, CAST(sum(CASE WHEN keep THEN n ELSE 0 END) AS INTEGER) AS n_kept,
               CASE WHEN bool_or(run = 1 AND NOT keep) THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS keep_runs
        FROM g GROUP BY doc_id""",
}
