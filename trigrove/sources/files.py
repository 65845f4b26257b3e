"""Small files on any Hadoop file system: read, create once, replace at once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


class Files:
    @staticmethod
    def plain(url: str) -> str:
        """A file's URL as a scan reports it, with one slash after "file:"."""
        return re.sub(r"^file:/+", "file:/", url)

    @staticmethod
    def urls(spark: SparkSession, paths: list[str]) -> dict[str, str]:
        """For each path its fully qualified URL, encoded as a scan reports the folder of a file."""
        path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        out = {}
        for p in paths:
            x = path(p)
            out[p] = Files.plain(x.getFileSystem(conf).makeQualified(x).toUri().toString()).rstrip("/")
        return out

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def modified(self, folder: str) -> dict[str, int]:
        """The names in a folder and when each was last written."""
        if not self.exists(folder):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in self._fs.listStatus(self._at(folder))}

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file, whole or not at all; False if it is there already."""
        if self.exists(name):
            return False
        tmp = self._write_tmp(name, text)
        return self._rename(tmp, name, overwrite=False)

    def replace(self, name: str, text: str) -> None:
        self._rename(self._write_tmp(name, text), name, overwrite=True)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def move(self, name: str, to: str) -> None:
        self._fs.mkdirs(self._at(to).getParent())
        self._fs.rename(self._at(name), self._at(to))

    def _write_tmp(self, name: str, text: str) -> str:
        folder, _, last = name.rpartition("/")
        tmp = f"{folder + '/' if folder else ''}.{last}.{self._jvm.java.util.UUID.randomUUID()}.tmp"
        out = self._fs.create(self._at(tmp), True)
        out.write(bytearray(text.encode()))
        out.close()
        return tmp

    def _rename(self, tmp: str, name: str, overwrite: bool) -> bool:
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        chosen = self.spark.sparkContext._gateway.new_array(options, 1)
        chosen[0] = options.OVERWRITE if overwrite else options.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._at(tmp), self._at(name), chosen)
            return True
        except Exception:
            self._fs.delete(self._at(tmp), False)
            if not overwrite and self.exists(name):
                return False
            raise


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all machines share: in spark.checkpoint.dir, or in the session's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='trigrove-')}"
    return f"{base}/{uuid.uuid4().hex}"
