"""The manifest: which segments each shard has, generation by generation.

Each generation is a file of its own, created once, so that of two writers only one
succeeds and readers always see whole generations. A generation lists all segments
of its shard, older ones first.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from trigrove.sources.files import Files


class ManifestConflict(RuntimeError):
    """Another writer has committed the expected generation."""


def parse_manifest(text: str) -> dict[int, dict[int, list[str]]]:
    """shard -> generation -> segments, from either layout of a manifest file:
    {"shards": {shard: gen}, "segments": {"shard:gen": [path]}} or {"version": 1, "shards": {shard: {"gen", "segments"}}}."""
    data = json.loads(text)
    shards = data.get("shards", {})
    out: dict[int, dict[int, list[str]]] = {}
    if data.get("version") == 1 and all(isinstance(v, dict) for v in shards.values()):
        for s, v in shards.items():
            out[int(s)] = {int(v["gen"]): list(v["segments"])}
        return out
    for key, paths in data.get("segments", {}).items():
        s, g = key.split(":")
        out.setdefault(int(s), {})[int(g)] = list(paths)
    for s, g in shards.items():
        out.setdefault(int(s), {}).setdefault(int(g), [])
    return out


class Manifest:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.files = Files(spark, root)

    def generations(self, shard: int) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"manifest/{shard}") if n.endswith(".json") and not n.startswith("."))

    def shards(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("manifest") if n.isdigit())

    def get(self, shard: int, gen: int | None = None) -> dict:
        """{"shard", "gen", "segments"} of a generation, the newest by default. KeyError if there is none."""
        known = self.generations(shard)
        if not known or (gen is not None and gen not in known):
            raise KeyError(f"shard {shard} has no generation {gen if gen is not None else 'at all'}")
        g = known[-1] if gen is None else gen
        return {"shard": shard, "gen": g, **json.loads(self.files.read(f"manifest/{shard}/{g:020d}.json"))}

    def append(self, shard: int, segments: list[str], expected_gen: int | None = None, note: str = "", only_new: bool = False, batch: int | None = None, files: list[str] | None = None) -> int:
        """Commits the next generation: the segments of the newest one and the new ones, or with ``only_new`` those alone. With
        ``expected_gen`` only if that is the newest one; ManifestConflict otherwise, and whenever another writer was faster.

        ``batch`` and ``files`` say which batch of an ingest it holds and what that was made of; later generations keep the number."""
        known = self.generations(shard)
        newest = known[-1] if known else 0
        if expected_gen is not None and expected_gen != newest:
            raise ManifestConflict(f"shard {shard} is at generation {newest}, not {expected_gen}")
        was = self.get(shard, newest) if known else {"segments": []}
        old = [] if only_new else was["segments"]
        held = set(old)
        entry = {"segments": old + [s for s in segments if s not in held], "note": note}
        if batch is not None or "batch" in was:
            entry |= {"batch": batch if batch is not None else was["batch"], "files": files or []}
        if not self.files.create(f"manifest/{shard}/{newest + 1:020d}.json", json.dumps(entry)):
            raise ManifestConflict(f"generation {newest + 1} of shard {shard} was committed by another writer")
        return newest + 1

    def newest(self, shard: int) -> dict:
        """The newest generation, or an empty one of number 0."""
        known = self.generations(shard)
        return self.get(shard, known[-1]) if known else {"shard": shard, "gen": 0, "segments": [], "note": ""}

    def migrate(self, text: str) -> None:
        """Takes over a manifest file of either layout; shards that have generations here already are an error."""
        parsed = parse_manifest(text)
        for s in parsed:
            if self.generations(s):
                raise ManifestConflict(f"shard {s} has generations already")
        for s, gens in parsed.items():
            for g, segments in sorted(gens.items()):
                self.files.create(f"manifest/{s}/{g:020d}.json", json.dumps({"segments": segments, "note": ""}))

    def resolve(self, shards: list[int] | None = None, pinned: dict[int, int] | None = None) -> tuple[list[tuple[int, int, int, str]], dict[int, int]]:
        """(shard, gen, ord, segment) of the newest or pinned generations, and which those are. Unknown shards are passed by."""
        rows, gens = [], {}
        for s in self.shards() if shards is None else shards:
            try:
                m = self.get(s, (pinned or {}).get(s))
            except KeyError:
                continue
            gens[s] = m["gen"]
            rows += [(s, m["gen"], i, p) for i, p in enumerate(m["segments"])]
        return rows, gens
