"""The landing folder: batches of JSON lines, each with a checksum beside it."""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import SparkSession

from trigrove.sources.files import Files


def checksum(text: str) -> str:
    return f"{zlib.crc32(text.encode()) & 0xFFFFFFFF:08x}"


class Landing:
    """Batches become visible whole, by a rename, after their checksum.

    A batch with a key is named by the key alone, so that of two writers of one key only one lands it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)

    def append(self, docs: list[dict], key: str | None = None) -> str | None:
        """The batch's name, or None if a batch of that key is there already."""
        name = f"{key or uuid.uuid4().hex}.jsonl"
        text = "".join(json.dumps(d, ensure_ascii=False) + "\n" for d in docs)
        total = checksum(text)
        # the checksum is of this very text: another writer of the key may have other documents
        self.files.create(f"sums/{name}.{total}", str(len(docs)))
        return name if self.files.create(f"batches/{name}", text) else None

    def sums(self) -> dict[str, dict[str, int]]:
        """For each batch its checksums and the number of documents of each."""
        out: dict[str, dict[str, int]] = {}
        for n in self.files.names("sums"):
            if not n.startswith("."):
                name, _, total = n.rpartition(".")
                out.setdefault(name, {})[total] = int(self.files.read(f"sums/{n}"))
        return out

    def valid(self, name: str) -> bool:
        """Whether a batch is as a checksum of it says; one without a checksum counts as valid."""
        known = [n.rpartition(".")[2] for n in self.files.names("sums") if n.rpartition(".")[0] == name]
        try:
            return not known or checksum(self.files.read(f"batches/{name}")) in known
        except UnicodeDecodeError:
            return False

    def take_away(self, name: str, to: str) -> None:
        """Moves a batch to another folder and forgets its checksums; one that is gone already is no error."""
        if self.files.exists(f"batches/{name}"):
            self.files.move(f"batches/{name}", f"{to}/{name}")
        for n in self.files.names("sums"):
            if n.rpartition(".")[0] == name:
                self.files.delete(f"sums/{n}")

    def quarantine(self, name: str) -> None:
        self.take_away(name, "quarantine")
