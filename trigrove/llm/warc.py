"""WARC: parsing of records and assembly of the records of one capture.

A capture is a response record with the request and metadata records that name
it, or name one another, in WARC-Concurrent-To. Links are resolved on record
ids alone; payloads move once, to their capture.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm.common import col, cut

RECORD = "record_id string, type string, date string, target_uri string, concurrent_to array<string>, content_type string, headers map<string,string>, payload binary, damage string"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_CHUNK = 1 << 20


def _headers(data: bytes) -> tuple[dict[str, str], list[str]]:
    """The headers of a record, names in lower case, and the values of WARC-Concurrent-To, which may repeat."""
    headers: dict[str, str] = {}
    links: list[str] = []
    name = ""
    for line in data.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and name:
            headers[name] += " " + text.strip()
            continue
        key, _, value = text.partition(":")
        name, value = key.strip().lower(), value.strip()
        if name == "warc-concurrent-to":
            links.append(value)
        headers[name] = value
    return headers, links


def _record(headers: dict[str, str], links: list[str], payload: bytes, damage: str | None = None) -> tuple:
    get = headers.get
    return get("warc-record-id"), get("warc-type"), get("warc-date"), get("warc-target-uri"), links, get("content-type"), headers, payload, damage


def records_of(chunks: Iterator[bytes]) -> Iterator[tuple]:
    """The records of the bytes of a WARC file that come in pieces, in the order of RECORD; no more than a record and a piece is held.

    A record ends with an empty line after its content. Where there is none, or the length can't be read, the length is wrong:
    the reading goes on at the next line that begins a record after an empty one, and what lies between is one record
    with the damage "length", or "truncated" if the bytes end first. Headers that don't end have the damage
    "header", bytes that belong to no record "garbage".
    """
    buf, at, last = bytearray(), 0, False
    while not last:
        data = next(chunks, None)
        last = data is None
        del buf[:at]
        at = 0
        buf += data or b""
        while at < len(buf):
            if buf[at] in b"\r\n":
                at += 1
                continue
            if not buf.startswith(b"WARC/", at):
                begin = buf.find(b"WARC/", at)
                if begin < 0 and not last:
                    break
                end = begin if begin >= 0 else len(buf)
                yield _record({}, [], bytes(buf[at:end]), "garbage")
                at = end
                continue
            head = buf.find(b"\r\n\r\n", at)
            if head < 0:
                if last:
                    yield _record({}, [], bytes(buf[at:]), "header")
                    at = len(buf)
                break
            headers, links = _headers(bytes(buf[at:head]))
            body = head + 4
            try:
                n = int(headers.get("content-length", ""))
            except ValueError:
                n = -1
            if n >= 0:
                end = body + n
                if end + 4 > len(buf) and not last:
                    break
                after = bytes(buf[end : end + 4])
                if end <= len(buf) and (after == b"\r\n\r\n" or end + len(after) == len(buf) and b"\r\n\r\n".startswith(after)):
                    yield _record(headers, links, bytes(buf[body:end]))
                    at = end
                    continue
            begin = buf.find(b"\r\n\r\nWARC/", head)
            if begin < 0 and not last:
                break
            end = begin if begin >= 0 else len(buf)
            yield _record(headers, links, bytes(buf[body:end]), "length" if begin >= 0 or n < 0 else "truncated")
            at = end


def parse_records(data: bytes) -> list[tuple]:
    """All records of the bytes of a WARC file, plain or of gzip members."""
    return list(_all_records(data))


def _all_records(data: bytes) -> Iterator[tuple]:
    """Gzip members are inflated piece by piece. Where one can't be, its bytes are a record with the damage "gzip", and the reading goes on at the next."""
    if data[:2] != b"\x1f\x8b":
        yield from records_of(data[i : i + _CHUNK] for i in range(0, len(data), _CHUNK))
        return
    at = 0
    while at < len(data):
        began, bad = at, None

        def inflated() -> Iterator[bytes]:
            nonlocal at, bad
            while data[at : at + 2] == b"\x1f\x8b":
                began, z = at, zlib.decompressobj(31)
                while not z.eof:
                    part = data[at : at + (1 << 16)]
                    if not part:
                        bad = began
                        return
                    try:
                        yield z.decompress(part)
                    except zlib.error:
                        bad = began
                        return
                    at += len(part) - len(z.unused_data)

        yield from records_of(inflated())
        if bad is None and at < len(data) and not data[at:].strip(b"\x00"):
            return
        if bad is not None or at < len(data):
            begin = at if bad is None else bad
            next_one = data.find(b"\x1f\x8b\x08", max(at, begin + 1))
            end = next_one if next_one >= 0 else len(data)
            yield _record({}, [], data[begin:end], "gzip")
            at = end
        if at == began:
            return


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    cols = list(zip(*rows)) or [()] * len(kinds)
    arrays = [pa.array([list(h.items()) for h in c] if n == "headers" else list(c), k) for c, k, n in zip(cols, kinds, _NAMES)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def read_warc(blocks: DataFrame, data_col: str = "content") -> DataFrame:
    """All records of a column of WARC bytes (of binaryFile, or any column), gzip members included; ``damage`` tells
    what is wrong with one, and is null where nothing is (see ``records_of``).

    Null and empty values hold no records; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i in range(b.num_rows):
                x = b.column(0)[i].as_py()
                for r in _all_records(x) if x else ():
                    rows.append(r)
                    size += len(r[7])
                    if size > 16 << 20:
                        yield _records(rows)
                        rows, size = [], 0
            yield _records(rows)

    return blocks.select(col(data_col).cast("binary")).mapInArrow(run, RECORD)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    return read_warc(spark.read.format("binaryFile").load(path))


def _captures_of(ids: DataFrame) -> DataFrame:
    """record_id and capture: the responses that are the least number of links away from each record that is none.

    Records that responses are linked to come first, then those linked to these, until no more are found.
    """
    links = ids.where("other IS NOT NULL AND other <> record_id").select(F.col("record_id").alias("a"), F.col("other").alias("b"))
    responses = ids.where("type = 'response'").select("record_id").distinct()
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    # a response leads nowhere but to itself
    links = cut(both.join(responses.select(F.col("record_id").alias("a")), "a", "left_anti"))
    found = new = cut(links.join(responses.select(F.col("record_id").alias("b")), "b", "left_semi").select(F.col("a").alias("record_id"), F.col("b").alias("capture")))
    while not new.isEmpty():
        # ids that are linked to what was found last, and were not found before
        ends = links.join(new.select(F.col("record_id").alias("b"), "capture"), "b").select(F.col("a").alias("record_id"), "capture")
        new = cut(ends.join(found.select("record_id").distinct(), "record_id", "left_anti").distinct())
        found = found.unionByName(new)
    return found


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: status, capture_id (the response's record id), target_uri, date,
    response, requests and metadata (arrays of structs, in order of record id).

    A request or metadata record belongs to the response that it names, that names it, or that
    a chain of such links leads to, however long; of several responses to all that are the least number of
    links away. These rows have the status "capture"; without requests or metadata the arrays are empty.

    A request or metadata record that leads to no response, and any record without an id, has a row of its own with
    the status "orphan" and no capture_id; a damaged record one with the status "damaged: " and what it is (its bytes are
    the response's payload). Other record types are left out. Of records with the same id only
    one counts, the one with the least payload in byte order; equal damaged ones, and equal ones without an id, count
    once. An empty table gives no rows; other columns are not read.
    """
    r = records.select(*[col(c) for c in _NAMES])
    sound = F.col("damage").isNull()
    named = sound & F.col("record_id").isNotNull()
    kinds = F.col("type").isin("response", "request", "metadata")
    # the ids are kept, so that the records are read for their links once
    ids = cut(r.where(named & kinds).select("record_id", "type", F.explode_outer(F.array_distinct(F.coalesce("concurrent_to", F.array()))).alias("other")))
    owners = _captures_of(ids)
    part = F.struct("payload", "record_id", "type", "date", "target_uri", "content_type", "headers")

    def single(rows: DataFrame, *keys: str) -> DataFrame:
        # equal ids: the least payload; maps have no order, so the choice is by the other columns
        return rows.groupBy(*keys).agg(F.min_by("part", F.struct("part.payload", "part.type", "part.date", "part.target_uri", "part.content_type")).alias("part"))

    # a response's id is its capture's, so its payload, which is most of the bytes, is shuffled by it once and stays there
    main = single(r.where(named & (F.col("type") == "response")).select("record_id", part.alias("part")), "record_id").withColumnRenamed("record_id", "capture")
    # what belongs to no capture is a group of its own
    odd = F.sha2(F.concat_ws("|", F.coalesce("damage", F.lit("")), *[F.coalesce(F.col(c), F.lit("")) for c in ("type", "record_id", "date", "target_uri")], F.hex("payload")), 256)
    alone = F.when(~named, F.concat(F.coalesce(F.concat(F.lit("damaged: "), F.col("damage")), F.lit("orphan")), F.lit("\n"), odd))
    rest = r.where(~named & (~sound | kinds) | named & F.col("type").isin("request", "metadata")).select("record_id", alone.alias("alone"), part.alias("part"))
    rest = rest.join(owners, "record_id", "left").select(F.coalesce("record_id", F.lit("")).alias("record_id"), "part", F.coalesce("alone", "capture", F.concat(F.lit("orphan\n"), "record_id")).alias("capture"), (F.col("alone").isNotNull() | F.col("capture").isNull()).alias("stray"))
    slim = F.struct(F.col("part.record_id"), F.col("part.date"), F.col("part.target_uri"), F.col("part.content_type"), F.col("part.headers"), F.col("part.payload"))
    whole = F.col("stray") & (F.col("capture").startswith("damaged") | ~F.coalesce(F.col("part.type"), F.lit("")).isin("request", "metadata"))
    others = (
        single(rest, "capture", "record_id", "stray")
        .groupBy("capture", "stray")
        .agg(
            F.collect_list(F.when(~whole & (F.col("part.type") == "request"), slim)).alias("req"),
            F.collect_list(F.when(~whole & (F.col("part.type") == "metadata"), slim)).alias("met"),
            F.first("part").alias("one"),
            F.first(whole).alias("whole"),
        )
    )
    got = main.withColumn("stray", F.lit(False)).join(others.hint("merge"), ["capture", "stray"], "full_outer")
    got = got.withColumns({n: F.coalesce(n, F.array().cast(others.schema[n].dataType)) for n in ("req", "met")})
    got = got.withColumn("shown", F.when(~F.col("stray") | F.col("whole"), F.coalesce("part", "one"))).withColumn("about", F.coalesce("part", "one"))

    def ordered(name: str) -> F.Column:
        return F.array_sort(name, lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0))

    return got.select(
        F.when(F.col("stray"), F.substring_index("capture", "\n", 1)).otherwise(F.lit("capture")).alias("status"),
        F.when(~F.col("stray"), F.col("capture")).alias("capture_id"),
        F.col("about.target_uri").alias("target_uri"),
        F.col("about.date").alias("date"),
        F.when(F.col("shown").isNotNull(), F.struct(F.col("shown.content_type").alias("content_type"), F.col("shown.headers").alias("headers"), F.col("shown.payload").alias("payload"))).alias("response"),
        ordered("req").alias("requests"),
        ordered("met").alias("metadata"),
    )


def pages_as_warc(pages: DataFrame) -> DataFrame:
    """A column ``content`` with the WARC bytes of each page: request, response and metadata records.

    The table has pages, not archives; this writes what a crawler would have. The
    metadata record names the request, so that its response is two links away.
    """
    # pages that differ in any of the three are captures of their own
    key = F.md5(F.concat_ws("|", F.coalesce(col("page_id").cast("string"), F.lit("")), F.coalesce(col("url"), F.lit("")), F.md5(F.coalesce(col("html"), F.lit("")))))

    def urn(kind: str) -> F.Column:
        return F.concat(F.lit(f"<urn:{kind}:"), key, F.lit(">"))

    def record(kind: str, mime: str, body: F.Column, concurrent: F.Column | None) -> F.Column:
        head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Record-ID: "), urn(kind), F.lit("\r\nWARC-Target-URI: "), F.coalesce(col("url"), F.lit(""))]
        if concurrent is not None:
            head += [F.lit("\r\nWARC-Concurrent-To: "), concurrent]
        head += [F.lit(f"\r\nContent-Type: {mime}\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")]
        return F.concat(*head)

    host = F.regexp_extract(F.coalesce(col("url"), F.lit("")), r"^[a-z]+://([^/?#]+)", 1)
    html = F.coalesce(col("html"), F.lit(""))
    request = F.concat(F.lit("GET "), F.coalesce(col("url"), F.lit("")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    response = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), html)
    meta = F.concat(F.lit("page: "), F.coalesce(col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    return pages.select(
        F.concat(
            record("request", "application/http; msgtype=request", request, urn("response")),
            record("response", "application/http; msgtype=response", response, None),
            record("metadata", "application/warc-fields", meta, urn("request")),
        )
        .cast("binary")
        .alias("content")
    )
