"""Ingest: a file stream over the landing folder builds segments and commits them to the manifest.

foreachBatch runs at least once; a generation tells which batch it holds, so a batch that is run again
changes nothing. Documents that have landed but are in no segment yet are hot: searches read them from the landing
folder. Batches that were committed move to a folder of their generation, so what has to be listed stays small.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.sources import documents
from trigrove.sources.files import Files
from trigrove.sources.landing import Landing
from trigrove.sources.manifest import Manifest

#: The segment of a hot document is this and its batch's name; its doc_id is the line, so both stay what they are.
HOT = "hot:"


class Backpressure(RuntimeError):
    """There is no room for the batch; ``retry_ms`` tells when to try again."""

    retry_ms = 1500


class Ingestor:
    """Ingest into one shard under ``root``. ``hot_cap`` bounds the documents that wait for a segment."""

    def __init__(self, spark: SparkSession, root: str, shard: int = 0, hot_cap: int = 10_000, max_files: int = 100) -> None:
        self.spark, self.root, self.shard, self.hot_cap, self.max_files = spark, root.rstrip("/"), shard, hot_cap, max_files
        self.landing, self.manifest, self.files = Landing(spark, self.root), Manifest(spark, self.root), Files(spark, self.root)

    def submit(self, docs: dict | list[dict], key: str | None = None) -> dict:
        """Lands a batch. A key that has landed before makes it a duplicate; the key is recorded only with
        the batch, so one that was turned away may come again. Raises Backpressure at the cap.

        The batch is named by its key, so its creation decides between writers of one key. A repeat that
        lands just after its batch was committed and moved away is left out when it is to be committed itself."""
        batch = [docs] if isinstance(docs, dict) else list(docs)
        safe = _safe(key) if key is not None else None
        again = {"ok": True, "duplicate": True, "appended": 0}
        if safe is not None and (self.files.exists(f"keys/{safe}.jsonl") or self.files.exists(f"batches/{safe}.jsonl")):
            return again
        if self.hot_count() >= self.hot_cap:
            raise Backpressure(f"{self.hot_cap} documents are waiting")
        name = self.landing.append(batch, safe)
        return again if name is None else {"ok": True, "duplicate": False, "appended": len(batch), "batch": name}

    def _waiting(self) -> list[str]:
        """Batches that no generation holds, in order of time."""
        done = set(self.manifest.newest(self.shard).get("files", []))
        found = self.files.modified("batches")
        return sorted((n for n in found if n.endswith(".jsonl") and not n.startswith(".") and n not in done), key=lambda n: (found[n], n))

    def _read(self, files: list[str]) -> DataFrame:
        """Stored documents of batches, by path from the root, as segments of their own."""
        rows = self.spark.read.text([f"{self.root}/{n}" for n in files], wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("doc_id", "value"))
        order = self.spark.createDataFrame([(n.rpartition("/")[2], i) for i, n in enumerate(files)], "file string, ord int")
        d = documents.from_json(rows, malformed="skip").join(F.broadcast(order), "file")
        return d.select(F.lit(2**62).cast("long").alias("shard"), F.lit(0).cast("long").alias("gen"), F.concat(F.lit(HOT), "file").alias("segment"), "ord", "doc_id", "ext_id", "fields")

    def hot(self, pinned: int | None = None) -> DataFrame:
        """The newest ``hot_cap`` documents that no segment holds yet, as stored documents that come after all others.

        With a pinned generation also those of batches that later generations hold, which a reader of that generation doesn't see."""
        files = [f"batches/{n}" for n in self._waiting()]
        if pinned is not None:
            later = sorted(int(n) for n in self.files.names(f"committed/{self.shard}") if int(n) > pinned)
            names = [f"committed/{self.shard}/{g}" for g in later]
            files = [f"{f}/{n}" for f in names for n in self.files.names(f) if not n.startswith(".")] + files
        if not files:
            return self.spark.createDataFrame([], documents.STORED)
        return self._read(files).orderBy(F.desc("ord"), F.desc("doc_id")).limit(self.hot_cap)

    def hot_count(self) -> int:
        """How many documents wait, as their checksums say."""
        waiting = self._waiting()
        known = self.landing.sums() if waiting else {}
        return sum(max(known.get(n, {"": 0}).values()) for n in waiting)

    def _commit(self, batch: DataFrame, batch_id: int) -> None:
        newest = self.manifest.newest(self.shard)
        if newest.get("batch", -1) >= batch_id:
            # it was committed, but the run broke off before all its files were moved
            for g in reversed(self.manifest.generations(self.shard)):
                entry = self.manifest.get(self.shard, g)
                if entry.get("batch") == batch_id and entry.get("files"):
                    self._move(entry["files"], g)
                    return
            return
        batch = batch.withColumn("at", F.monotonically_increasing_id())
        names = [r[0] for r in batch.select("file").distinct().collect()]
        bad = [n for n in names if self.files.exists(f"batches/{n}") and not self.landing.valid(n)]
        again = [n for n in names if n not in bad and self.files.exists(f"keys/{n}")]
        left = [n for n in names if n not in bad and n not in again]
        path = f"{self.root}/segments/{self.shard}-{batch_id:012d}"
        self.files.delete(f"segments/{self.shard}-{batch_id:012d}")  # what an attempt that broke off has left
        if left:
            documents.write_segment(documents.from_json(batch.where(F.col("file").isin(left)), malformed="skip"), path, ["time", "file", "at"])
        gen = self.manifest.append(self.shard, [path] if left else [], note=f"{self.shard}:{batch_id}", batch=batch_id, files=left)
        for n in bad:  # only now, since the batch is read lazily from its files
            self.landing.quarantine(n)
        for n in again:
            self.landing.take_away(n, "repeats")
        self._move(left, gen)

    def _move(self, names: list[str], gen: int) -> None:
        for n in names:
            self.files.create(f"keys/{n}", str(gen))
            self.landing.take_away(n, f"committed/{self.shard}/{gen}")

    def merge(self, least: int) -> int:
        """Joins neighbouring segments of under ``least`` documents until they have as many, and commits that as a
        generation; pinned older ones keep their segments. The number of segments that went."""
        newest = self.manifest.newest(self.shard)
        rows = [(self.shard, newest["gen"], i, p) for i, p in enumerate(newest["segments"])]
        if len(rows) < 2:
            return 0
        stored = documents.open_segments(self.spark, rows)
        sizes = {r.segment: r.n for r in stored.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
        out: list[list[tuple]] = []
        room = 0
        for r in rows:
            n = sizes.get(r[3], 0)
            if out and room > 0 and n < least:
                out[-1].append(r)
                room -= n
            else:
                out.append([r])
                room = least - n
        paths = []
        for k, group in enumerate(out):
            if len(group) == 1:
                paths.append(group[0][3])
                continue
            path = f"{self.root}/segments/{self.shard}-merged-{newest['gen'] + 1:012d}-{k}"
            self.files.delete(path[len(self.root) + 1 :])
            documents.write_segment(documents.open_segments(self.spark, group), path, ["ord", "doc_id"])
            paths.append(path)
        if len(paths) < len(rows):
            self.manifest.append(self.shard, paths, expected_gen=newest["gen"], note="merged", only_new=True)
        return len(rows) - len(paths)

    def run(self, available_now: bool = True):
        """Starts the stream; with ``available_now`` it ends when all that has landed is committed."""
        self.files._fs.mkdirs(self.files._at("batches"))
        rows = self.spark.readStream.option("maxFilesPerTrigger", self.max_files).text(f"{self.root}/batches")
        rows = rows.withColumn("file", F.col("_metadata.file_name")).withColumn("time", F.col("_metadata.file_modification_time"))
        out = rows.writeStream.foreachBatch(self._commit).option("checkpointLocation", f"{self.root}/stream/{self.shard}")
        return (out.trigger(availableNow=True) if available_now else out).start()

    def drain(self) -> None:
        self.run().awaitTermination()


def _safe(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()[:32]
