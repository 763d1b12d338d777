"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder: shard folders that are never changed, and manifests
``manifest-<version>.json`` that list the live shards. Arrivals are appended as
small shards. When a tier (shards of similar size) has ``fan_in`` of them, they
are merged into files of about the target size. A commit writes the next
manifest under another name and renames it into place; the rename fails if that
version exists, so of two writers one wins and readers see whole versions only.
That needs a file system whose rename is atomic and never replaces (HDFS, a
POSIX folder); on an object store without one, writers must be kept to one.
Shards that a merge replaces stay until no retained version lists them, so a
reader of such a version never loses its files.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, delete, hadoop_path, unused

#: Bytes of a finished file, of the smallest tier, runs that are merged at once, appends of one table, versions that stay readable.
TARGET, SMALLEST, FAN_IN, ARRIVALS, RETAIN = 64 << 20, 1 << 20, 4, 8, 4
#: Seconds after which a folder that no manifest lists is taken for one that a dead writer left.
ORPHAN = 7 * 86_400.0
#: Shards are written once and kept by versions: texts take about two thirds of the room that they take by the session's default.
CODEC = "zstd"


@dataclass(frozen=True)
class Shard:
    name: str
    files: int
    size: int
    rows: int


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class Store:
    """One sharded table. Any number of readers; writers retry on Conflict."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, smallest: int = SMALLEST, fan_in: int = FAN_IN, retain: int = RETAIN):
        if fan_in < 2 or target < 1 or smallest < 1 or retain < 1:
            raise ValueError("fan_in must be at least 2, sizes and retained versions at least 1")
        self.spark, self.path, self.target, self.smallest, self.fan_in, self.retain = spark, path.rstrip("/"), target, smallest, fan_in, retain

    def versions(self) -> list[int]:
        fs, p = hadoop_path(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """(version, shards) of the last version, or of a given one; the last is looked for again if others have expired it meanwhile."""
        while True:
            known = self.versions()
            if not known:
                return 0, []
            asked = known[-1] if version is None else version
            try:
                return self._manifest(asked)
            except Exception:
                if asked in self.versions():
                    raise
                if version is not None:
                    raise KeyError(f"version {version} is not there or has expired") from None

    def _manifest(self, version: int) -> tuple[int, list[Shard]]:
        fs, p = hadoop_path(self.spark, f"{self.path}/manifest-{version:08d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return version, [Shard(**s) for s in held["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Makes ``shards`` version base + 1; Conflict if that version exists."""
        version = base + 1
        fs, final = hadoop_path(self.spark, f"{self.path}/manifest-{version:08d}.json")
        _, draft = hadoop_path(self.spark, f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {version} exists")
        return version

    def _shard(self, name: str, rows: int) -> Shard:
        fs, p = hadoop_path(self.spark, f"{self.path}/{name}")
        sizes = [s.getLen() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")] if fs.exists(p) else []
        return Shard(name, len(sizes), sum(sizes), rows)

    def _write(self, df: DataFrame, part: Column | None = None, parts: int = 1) -> list[Shard]:
        """One shard, or one for each value of ``part`` (0 to ``parts`` - 1), in one pass; rows are counted as they are written."""
        name, seen = f"shard-{uuid.uuid4().hex}", Observation(uuid.uuid4().hex)
        if part is None:
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", CODEC).parquet(f"{self.path}/{name}")
            return [self._shard(name, seen.get["n"])]
        key = unused("arrival", df)
        counts = [F.count_if(F.col(key) == k).alias(f"n{k}") for k in range(parts)]
        df.withColumn(key, part).observe(seen, *counts).write.option("compression", CODEC).partitionBy(key).parquet(f"{self.path}/{name}")
        return [self._shard(f"{name}/{key}={k}", seen.get[f"n{k}"]) for k in range(parts)]

    def append(self, df: DataFrame, part: Column | None = None, parts: int = 1) -> list[Shard]:
        """Adds the rows of ``df`` as immutable shards, one version for each; a shard without rows leaves nothing but its version."""
        added = self._write(df, part, parts)
        for shard in added:
            while True:
                base, shards = self.manifest()
                try:
                    self.commit(base, [*shards, shard] if shard.rows else shards)
                    break
                except Conflict:
                    continue
        return added

    def tier(self, shard: Shard) -> int:
        """0 for shards up to the smallest size, then one more for each factor of ``fan_in``; finished files have none (-1)."""
        if shard.size >= self.target * max(1, shard.files) * 0.75:
            return -1
        return max(0, math.ceil(math.log(max(1, shard.size) / self.smallest, self.fan_in)))

    def due(self, shards: list[Shard]) -> list[Shard] | None:
        """The runs that the next merge takes: ``fan_in`` of the lowest tier with enough of them, smallest first."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s), []).append(s)
        tiers.pop(-1, None)
        for _, runs in sorted(tiers.items()):
            if len(runs) >= self.fan_in:
                return sorted(runs, key=lambda s: (s.size, s.name))[: self.fan_in]
        return None

    def compact(self, schema) -> int:
        """Merges until no tier is due; returns how many merges ran."""
        merges = 0
        while runs := self.due(self.manifest()[1]):
            total = sum(s.size for s in runs)
            files = max(1, round(total / self.target))
            # Whole input files are put together: nothing is shuffled.
            try:
                (merged,) = self._write(self._open([s.name for s in runs], schema).coalesce(files))
            except Exception:
                # Another writer may have merged these and expired them.
                if {s.name for s in runs} <= {s.name for s in self.manifest()[1]}:
                    raise
                continue
            if merged.rows != sum(s.rows for s in runs):
                raise RuntimeError(f"a merge wrote {merged.rows} rows of {sum(s.rows for s in runs)}")
            while True:
                base, now = self.manifest()
                if not {s.name for s in runs} <= {s.name for s in now}:
                    delete(self.spark, f"{self.path}/{merged.name}")
                    break
                try:
                    self.commit(base, [s for s in now if s not in runs] + [merged])
                except Conflict:
                    continue
                merges += 1
                break
        self.expire()
        return merges

    def _listed(self, version: int) -> list[Shard]:
        """The shards of a version, none if another writer has dropped it."""
        try:
            return self.manifest(version)[1]
        except KeyError:
            return []

    def orphans(self, older: float = ORPHAN) -> list[str]:
        """Folders that no manifest lists and that were last written more than ``older`` seconds ago.

        A failed append or a merge that lost its inputs to another writer may
        leave one; a younger folder may belong to an append that is not yet
        committed.
        """
        listed = {s.name.split("/")[0] for v in self.versions() for s in self._listed(v)}
        fs, p = hadoop_path(self.spark, self.path)
        held = fs.listStatus(p) if fs.exists(p) else []
        before = (time.time() - older) * 1000
        named = [(s.getPath().getName(), s.getModificationTime()) for s in held]
        return sorted(n for n, t in named if n.startswith(("shard-", ".draft-")) and n not in listed and 0 < t < before)

    def expire(self, older: float = ORPHAN) -> list[int]:
        """Drops all versions but the last ``retain``, the shards that only they list and ``orphans``; returns the dropped versions."""
        known = self.versions()
        old, kept = known[: -self.retain], known[-self.retain :]
        live = {s.name for v in kept for s in self.manifest(v)[1]}
        gone = {s.name for v in old for s in self._listed(v)} - live
        for v in old:
            delete(self.spark, f"{self.path}/manifest-{v:08d}.json")
        for name in [*gone, *self.orphans(older)]:
            delete(self.spark, f"{self.path}/{name}")
        return old

    def _open(self, names: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names))

    def read(self, schema, version: int | None = None, tag: str | None = None) -> DataFrame:
        """The rows of a version; ``tag`` names a column with each row's shard."""
        if version is not None and version not in self.versions():
            raise KeyError(f"version {version} is not there or has expired")
        _, shards = self.manifest(version)
        if not shards:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumn(tag, F.lit(None).cast("string")) if tag else rows
        rows = self._open([s.name for s in shards], schema)
        name = F.regexp_extract(F.col("_metadata.file_path"), r"(shard-[0-9a-f]{32}(?:/arrival_*=[0-9]+)?)/[^/]*$", 1)
        return rows.withColumn(tag, name) if tag else rows


def shard(docs: DataFrame, arrivals: int = ARRIVALS, target: int = TARGET, smallest: int = SMALLEST, fan_in: int = FAN_IN, path: str | None = None) -> tuple[Store, DataFrame]:
    """Appends ``docs`` in ``arrivals`` parts to a new store, compacts it, and reads its last version.

    An arrival is a range of the hash of the row's id and text; it holds about
    the same share of every source, so a large source makes no large shard. All
    arrivals are written in one pass over ``docs``. Nulls and repeated rows are
    rows like others, long texts stay whole, an empty table gives an empty
    version, and extra columns are kept whatever their names.
    """
    spark = docs.sparkSession
    store = Store(spark, path or Workspace(spark, "store").path, target, smallest, fan_in)
    store.append(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals)).cast("int"), arrivals)
    store.compact(docs.schema)
    return store, store.read(docs.schema)
