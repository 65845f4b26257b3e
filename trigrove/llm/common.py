"""Small helpers of the operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the session's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # one machine: its own folder is shared by all there is
        folder = f"file://{tempfile.mkdtemp(prefix='trigrove-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def partitions(df: DataFrame, each: int = 64 << 20) -> int:
    """The session's shuffle partitions, or more if what ``df`` reads has over ``each`` bytes for one."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # a plan whose size isn't known claims the greatest there is
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // each))


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed now and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: like ``cut``, for rows that compress well."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a sieve: 2,048 bitmaps of 4 KB each, whatever the input.
SIEVE_BITS = 1 << 26


def _place(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(SIEVE_BITS))


def sifted(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id may be in the one column of ``ids``, all those that are among them; nulls go.

    A Bloom filter of SIEVE_BITS bits is joined on by broadcast, at most 8 MB however many the ids
    are. It spares a join that follows the shuffle of rows that it would drop; with very many ids more rows pass.
    """
    (name,) = ids.columns
    here = _place(col(id_col))
    return _with_bit(df, here, _bitmaps(ids.where(col(name).isNotNull()), _place(col(name))))


def _bitmaps(df: DataFrame, at: Column) -> DataFrame:
    return df.groupBy(F.shiftright(at, 15).alias("__bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("__bits"))


def _with_bit(df: DataFrame, here: Column, maps: DataFrame) -> DataFrame:
    found = df.join(F.broadcast(maps), F.shiftright(here, 15) == F.col("__bucket")).withColumn("__at", here.bitwiseAND(F.lit(32767)).cast("int"))
    byte = "cast(conv(hex(substr(__bits, shiftright(__at, 3) + 1, 1)), 16, 10) AS int)"
    return found.where(f"shiftright({byte}, __at & 7) & 1 = 1").drop("__bucket", "__bits", "__at")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``cut`` with a number for each row, by which ``chosen`` finds it again."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def chosen(df: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """Exactly the rows of a ``numbered`` table whose number is in the one column of ``ids``: no row is shuffled or written.

    The numbers are broadcast as bitmaps: a bit for each row, 4 KB at least for each partition of the table.
    """
    (key,) = ids.columns
    return _with_bit(df, col(name), cut(_bitmaps(ids, col(key))))


#: Seconds that ``free`` waits at most.
_WAIT_S = 10


def free(spark: SparkSession) -> None:
    """Lets shuffle files go that only tables refer to which are no longer in use; else they stay until the driver happens to collect its garbage.

    The JVM hears of tables that Python has dropped in order, but from a thread that may sleep for a second, and holds them
    until then. So a probe is dropped after them, and garbage is collected until the probe is gone too.
    """
    jvm = spark.sparkContext._jvm
    gc.collect()
    probe = jvm.java.lang.ref.WeakReference(jvm.java.lang.Object())
    until = time.monotonic() + _WAIT_S
    while True:
        gc.collect()
        jvm.System.gc()
        if probe.refersTo(None) or time.monotonic() > until:
            return
        time.sleep(0.2)


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow over all columns, whatever their names; ``run`` sees and gives them by position."""
    names = schema.names

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(named, schema)


def by_key(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole runs of the first column, which is in order, and where the runs begin (one more at the end)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def take(final: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = whole.column(0).to_numpy(zero_copy_only=False)
        n = len(key) if final else int(np.searchsorted(key, key[-1]))
        return whole.slice(0, n), whole.slice(n) if n < len(key) else None

    def edges(x: pa.RecordBatch) -> np.ndarray:
        key = x.column(0).to_numpy(zero_copy_only=False)
        return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
            if size > rows:
                ready, rest = take(False)
                held = [rest] if rest is not None else []
                size, rows = sum(x.num_rows for x in held), max(rows, 2 * sum(x.num_rows for x in held))
                if ready.num_rows:
                    yield ready, edges(ready)
    if held:
        ready, _ = take(True)
        yield ready, edges(ready)
