"""Token counts as rollups that signed changes keep up to date.

A batch of changes becomes signed additive deltas per source, language and
tokenizer version. It is committed once under its id: data first, then, by an atomic
rename that overwrites nothing, a marker. A batch that is sent again changes nothing, and one that broke off leaves nothing that counts.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm import kernels
from trigrove.llm.common import col

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
TOKENIZERS = "/opt/tokenizers"
#: How byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker reads each vocabulary once.
_COUNTERS: dict[tuple, Callable[[list], np.ndarray]] = {}


def word_counter(texts: list[str | None]) -> np.ndarray:
    """Words as kernels.words has them."""
    parts = [np.diff(w.splits) for w in kernels.words(pa.array(texts, pa.string()))]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def bpe_counter(file: str, pattern: str) -> Callable[[list], np.ndarray]:
    """Counts tokens of a byte-level BPE vocabulary of tiktoken's format; special tokens are ordinary text."""
    import tiktoken

    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda texts: np.fromiter((len(encode(t)) if t else 0 for t in texts), np.int64, len(texts))


def count_tokens(docs: DataFrame, tokenizers: dict[str, tuple[str, str] | None]) -> DataFrame:
    """doc_id, source, lang, n_chars and counts, a map from tokenizer version to tokens.

    ``tokenizers`` gives for each version the vocabulary's file and split pattern, or
    None for plain words. Null and empty texts have 0 tokens and characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            columns = []
            for spec in tokenizers.values():
                if spec is None:
                    columns.append(word_counter(texts))
                else:
                    if spec not in _COUNTERS:
                        _COUNTERS[spec] = bpe_counter(*spec)
                    columns.append(_COUNTERS[spec](texts))
            n = len(texts)
            items = np.stack(columns, axis=1).reshape(-1) if columns else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * len(tokenizers))
            counts = pa.MapArray.from_arrays(offsets, pa.array(list(tokenizers) * n, pa.string()), pa.array(items, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(t or "") for t in texts], pa.int64()), counts], names=["doc_id", "source", "lang", "n_chars", "counts"])

    d = docs.select(col("doc_id").cast("long").alias("doc_id"), col("source").cast("string").alias("source"), col("lang").cast("string").alias("lang"), col("text").alias("text"))
    return d.mapInArrow(run, "doc_id long, source string, lang string, n_chars long, counts map<string,long>")


def signed(counted: DataFrame, sign: int) -> DataFrame:
    """Counted documents as changes: +1 inserts, -1 deletes. A revision is the old count at -1 with the new one at +1."""
    return counted.select("source", "lang", F.explode("counts").alias("tokenizer", "tokens"), "n_chars").select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("tokens") * sign).alias("n_tokens"), (F.col("n_chars") * sign).alias("n_chars"))


class TokenRollup:
    """Totals in a folder of any Hadoop file system.

    ``apply`` commits a batch of changes (source, lang, tokenizer, n_docs, n_tokens, n_chars, all
    signed) under an id of letters, digits, "_", "." and "-"; it returns False if that id is committed already. ``totals`` gives the
    sums of all committed batches, without keys whose sums are all 0. ``compact`` folds committed
    batches into one, which keeps their ids. Null keys are keys of their own; null amounts count as
    0; other columns of the changes are not read; an empty batch is committed too.

    Each attempt writes to a folder of its own, which its marker names; of several writers of one id the
    one that creates the marker counts, and what the others wrote is never read or overwritten.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path("commits"))] if self._fs.exists(self._path("commits")) else []

    def _lines(self, name: str) -> list[str]:
        stream = self._fs.open(self._path(f"commits/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()

    def committed(self) -> dict[str, str]:
        """For each committed id, the data that its amounts are in. Markers of batches that were folded aren't read."""
        names = self._names()
        out: dict[str, str] = {}
        folds = sorted((n for n in names if n.startswith("compact=")), key=lambda n: int(n.split("=")[1]))
        if folds:  # the last one holds all that those before hold
            data, *ids = self._lines(folds[-1])
            out = dict.fromkeys(ids, data)
        return out | {n: self._lines(n)[0] for n in names if n not in out and not n.startswith("compact=")}

    def _mark(self, name: str, text: str) -> bool:
        """Creates a commit marker; False if there is one. Only the creation counts, so two writers can't both win.

        The text is written aside and moved there whole, so no marker is ever read half."""
        aside = self._path(f"aside/{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        gateway, jvm = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        self._fs.mkdirs(self._path("commits"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._path(f"commits/{name}"), options)
            return True
        except Exception:  # the JVM's FileAlreadyExistsException
            self._fs.delete(aside, False)
            if self._fs.exists(self._path(f"commits/{name}")):
                return False
            raise

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        if not re.fullmatch(r"[\w.-]+", batch_id, re.A):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self._fs.exists(self._path(f"commits/{batch_id}")):
            return False
        deltas = changes.groupBy(*[col(k).cast("string").alias(k) for k in KEYS]).agg(*[F.coalesce(F.sum(col(s).cast("long")), F.lit(0)).alias(s) for s in SUMS])
        return self._commit(batch_id, deltas, [])

    def _commit(self, name: str, rows: DataFrame, ids: list[str]) -> bool:
        data = f"data/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        won = self._mark(name, "\n".join([data, *ids]))
        if not won:
            self._fs.delete(self._path(data), True)
        return won

    def totals(self) -> DataFrame:
        return self._totals(self.committed())

    def _totals(self, committed: dict[str, str]) -> DataFrame:
        data = sorted(set(committed.values()))
        if not data:
            return self.spark.createDataFrame([], ", ".join([f"{k} string" for k in KEYS] + [f"{s} long" for s in SUMS]))
        rows = self.spark.read.schema(", ".join([f"{k} string" for k in KEYS] + [f"{s} long" for s in SUMS])).parquet(*[f"{self.folder}/{p}" for p in data])
        t = rows.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS])
        return t.where(" OR ".join(f"{s} <> 0" for s in SUMS))

    def compact(self) -> bool:
        """Folds what is committed now; False if another compaction was faster, whose fold then counts."""
        ids = self.committed()
        if not ids:
            return False
        n = 1 + max([int(x.split("=")[1]) for x in self._names() if x.startswith("compact=")] or [0])
        return self._commit(f"compact={n}", self._totals(ids).coalesce(1), sorted(ids))
