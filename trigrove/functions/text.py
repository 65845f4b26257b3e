"""Normalization, flattening of JSON and trigrams."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKS = re.compile("[̀-ͯ]+")


def normalize(s: str) -> str:
    """Lower case, then NFKC, then NFD without the combining marks U+0300 to U+036F."""
    if s.isascii():
        return s.lower()
    return _MARKS.sub("", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", s.lower())))


#: Bytes of texts that are Python strings at once.
_PIECE_BYTES = 1 << 20


def _pieces(column: pa.Array) -> Iterator[pa.Array]:
    """The column in slices of at most so many bytes, or one row."""
    total = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _PIECE_BYTES, side="right")) - 1)
        yield column.slice(lo, hi - lo)
        lo = hi


@F.arrow_udf(T.StringType())
def _normalize_other(column: pa.Array) -> pa.Array:
    # a batch has many texts; only a piece of it is held as Python strings
    parts = [pa.array([None if s is None else normalize(s) for s in x.to_pylist()], pa.string()) for x in _pieces(column)]
    return pa.concat_arrays(parts) if parts else pa.nulls(0, pa.string())


def normalized(c: Column | str) -> Column:
    """``normalize`` of a column. ASCII texts are lowered in the JVM; only others go to Python."""
    c = F.col(c) if isinstance(c, str) else c
    ascii_only = F.octet_length(c) == F.length(c)
    return F.coalesce(_normalize_other(F.when(~ascii_only, c)), F.lower(c))


def flatten_json(value: object) -> list[tuple[str, str]]:
    """All strings within a JSON value with their paths (a.b, tags[0]), in order of occurrence; other scalars are dropped."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, object]] = [("", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, str):
            out.append((path, v))
        elif isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v))))
    return out


_FIELDS = T.MapType(T.StringType(), T.StringType())


@F.arrow_udf(_FIELDS)
def flatten_fields(column: pa.Array) -> pa.Array:
    """JSON text to a map from path to normalized string; of equal paths the last wins, malformed text gives null."""
    rows: list[list[tuple[str, str]] | None] = []
    for s in column.to_pylist():
        try:
            rows.append(None if s is None else list({p: normalize(v) for p, v in flatten_json(json.loads(s.lstrip("﻿")))}.items()))
        except ValueError:
            rows.append(None)
    return pa.array(rows, pa.map_(pa.string(), pa.string()))


@F.arrow_udf(T.StringType())
def external_id(column: pa.Array) -> pa.Array:
    """The root's _id if it is a string, else null."""
    out = []
    for s in column.to_pylist():
        try:
            v = None if s is None else json.loads(s.lstrip("﻿"))
        except ValueError:
            v = None
        i = v.get("_id") if isinstance(v, dict) else None
        out.append(i if isinstance(i, str) else None)
    return pa.array(out, pa.string())


def trigrams(s: str) -> list[str]:
    """All windows of three code points, repeats included."""
    return [s[i : i + 3] for i in range(len(s) - 2)]


def gram_rows(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys`` and each distinct trigram of ``text`` as ``gram``; null and short texts give no rows.

    A batch's trigrams are packed code points; sorting finds the distinct ones of each
    row, and each distinct trigram of the batch becomes a string once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < 1 << 20):
                    size += len(texts[hi] or "")
                    hi += 1
                part = [t or "" for t in texts[lo:hi]]
                cps = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                lengths = np.array([len(t) for t in part], np.int64)
                ends = np.repeat(np.cumsum(lengths), lengths)
                if len(cps) >= 3:
                    code = (cps[:-2] << np.uint64(42)) | (cps[1:-1] << np.uint64(21)) | cps[2:]
                    ok = np.arange(len(code)) + 3 <= ends[: len(code)]
                    row = np.repeat(np.arange(hi - lo), lengths)[: len(code)][ok]
                    known, number = np.unique(code[ok], return_inverse=True)
                    pair = np.unique(row * np.int64(max(1, len(known))) + number)
                    row, number = np.divmod(pair, max(1, len(known)))
                    m = np.uint64((1 << 21) - 1)
                    names = pa.array([chr(int(c >> np.uint64(42))) + chr(int((c >> np.uint64(21)) & m)) + chr(int(c & m)) for c in known], pa.string())
                    take = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays([b.column(i).take(take) for i in range(len(keys))] + [names.take(pa.array(number))], names=[*keys, "gram"])
                lo = hi

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("gram", T.StringType())])
    return df.select(*keys, text).mapInArrow(run, schema)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _trigrams_of(column: pa.Array) -> pa.Array:
    return pa.array([None if s is None else trigrams(s) for s in column.to_pylist()], pa.list_(pa.string()))


def register(spark: SparkSession) -> None:
    """normalize_text, flatten_json and trigrams as SQL functions."""
    spark.udf.register("trigrams", _trigrams_of)
    spark.udf.register("normalize_text", _normalize_other)
    spark.udf.register("flatten_json", flatten_fields)
