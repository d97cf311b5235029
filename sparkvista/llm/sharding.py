"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards, one for each task that writes, without a shuffle. Shards of
similar size form a tier; a tier with enough of them is merged, in one Spark job, into files of about the
target size. What a reader sees is a manifest, a numbered file that a commit puts in place by one rename that
fails if the number is taken; the writer that comes second commits after the first. Old versions stay readable
until vacuum().
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a finished shard, shards of a tier that start a merge, bytes up to which a shard is of the lowest tier.
TARGET, FANOUT, SMALL = 64 << 20, 4, 8 << 20
#: Seconds for which vacuum() spares files that no version names: a week.
GRACE_S = 7 * 86_400.0


class CommitConflict(RuntimeError):
    """Another writer has committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int

    def tier(self, fanout: int = FANOUT, small: int = SMALL) -> int:
        return 0 if self.bytes <= small else 1 + int(math.log(self.bytes / small, fanout))


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str | None
    shards: tuple[Shard, ...]


def merge_groups(shards: Sequence[Shard], target: int = TARGET, fanout: int = FANOUT, small: int = SMALL) -> list[list[Shard]]:
    """Which shards to merge: in each tier of at least `fanout` unfinished shards, as many as fit the target, by size."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < target / 2:
            tiers.setdefault(s.tier(fanout, small), []).append(s)
    groups = []
    for tier in tiers.values():
        if len(tier) < fanout:
            continue
        group: list[Shard] = []
        for s in sorted(tier, key=lambda s: (s.bytes, s.path)):
            if group and sum(x.bytes for x in group) + s.bytes > target:
                groups.append(group)
                group = []
            group.append(s)
        groups.append(group)
    return [g for g in groups if len(g) > 1]


def _shard_path() -> Column:
    """The path of a row's shard as manifests have it."""
    return F.regexp_extract(F.replace(F.col("_metadata.file_path"), F.lit("%3D"), F.lit("=")), "(data/[0-9a-f]{32}/.*)$", 1)


class ShardStore:
    """A table of shards under `path`, a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT, small: int = SMALL):
        self.spark, self.path, self.target, self.fanout, self.small = spark, path.rstrip("/"), target, fanout, small
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _list(self, name: str) -> list[tuple[str, int]]:
        if not self._fs.exists(self._path(name)):
            return []
        return [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(name))]

    # -- versions

    def version(self) -> int:
        """The last committed version; 0: none."""
        found = [re.fullmatch(r"v(\d+)\.json", n) for n, _ in self._list("manifest")]
        return max((int(m[1]) for m in found if m), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        if not version:
            return Manifest(0, None, ())
        stream = self._fs.open(self._path(f"manifest/v{version:010d}.json"))
        try:
            raw = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        x = json.loads(raw)
        return Manifest(x["version"], x["schema"], tuple(Shard(**s) for s in x["shards"]))

    def _commit(self, base: Manifest, schema: str | None, shards: Sequence[Shard]) -> Manifest:
        new = Manifest(base.version + 1, schema, tuple(shards))
        draft = self._path(f"manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": new.version, "schema": schema, "shards": [asdict(s) for s in new.shards]}).encode()))
        finally:
            out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        rename = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = options
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, self._path(f"manifest/v{new.version:010d}.json"), rename)
        except Exception as e:
            self._fs.delete(draft, False)
            if self.version() >= new.version:
                raise CommitConflict(f"version {new.version} of {self.path} exists") from e
            raise
        return new

    # -- writing

    def _publish(self, change: Callable[[Manifest], Sequence[Shard] | None], schema: str | None = None) -> Manifest | None:
        """Commits change(the last version), anew each time another writer has been faster; None if change() gives it up."""
        while True:
            base = self.manifest()
            shards = change(base)
            if shards is None:
                return None
            try:
                return self._commit(base, schema or base.schema, shards)
            except CommitConflict:
                continue

    def _written(self, folder: str) -> list[Shard]:
        """The shards below a folder that a job has written, with their rows from the files' footers."""
        sizes = {f"{folder}/{n}": b for n, b in self._list(folder) if n.endswith(".parquet")}
        for inner, _ in self._list(folder):
            if "=" in inner:
                sizes |= {f"{folder}/{inner}/{n}": b for n, b in self._list(f"{folder}/{inner}") if n.endswith(".parquet")}
        if not sizes:
            return []
        files = self.spark.read.parquet(f"{self.path}/{folder}").groupBy(_shard_path().alias("file")).count()
        rows = {r["file"]: r["count"] for r in files.collect()}
        return [Shard(n, rows[n], b) for n, b in sorted(sizes.items()) if rows.get(n)]

    def stage(self, df: DataFrame, part: Column | None = None) -> dict[int, list[Shard]]:
        """Writes the rows of df as small shards that no version has yet, by the number of their part (0 without parts).

        One scan and no shuffle; every writing task makes one shard of each part. add() commits them. What is
        never committed stays invisible, and goes with vacuum() after a time of grace.
        """
        folder = f"data/{uuid.uuid4().hex}"
        out = df if part is None else df.withColumn("__part", part)
        out.write.option("compression", "zstd").partitionBy(*([] if part is None else ["__part"])).parquet(f"{self.path}/{folder}")
        found: dict[int, list[Shard]] = {}
        for s in self._written(folder):
            m = re.search(r"/__part=(\d+)/", s.path)
            found.setdefault(int(m[1]) if m else 0, []).append(s)
        return found

    def add(self, shards: Sequence[Shard], schema: T.StructType) -> Manifest:
        """Commits staged shards as the next version, after those of other writers."""
        return self._publish(lambda m: [*m.shards, *shards], schema.json())

    def append(self, df: DataFrame) -> Manifest:
        """Adds the rows of df: every writing task makes one small shard. An empty df adds a version without one."""
        return self.add(self.stage(df).get(0, []), df.schema)

    def compact(self) -> Manifest:
        """Merges the tiers that are full, all in one job, and commits; without such tiers nothing changes.

        Each group of shards becomes one file, written by a task of its own, and holds no more than the target's
        bytes. If another writer has merged one of the shards meanwhile, this merge is given up and its files go.
        """
        base = self.manifest()
        groups = merge_groups(base.shards, self.target, self.fanout, self.small)
        if not groups:
            return base
        folder = f"data/{uuid.uuid4().hex}"
        where = {s.path: k for k, g in enumerate(groups) for s in g}
        # names of files, far fewer than rows: a broadcast of the plan that the manifest holds anyway
        names = self.spark.createDataFrame([(p, k) for p, k in where.items()], "__file string, __group int")
        rows = self._open(where, base.schema).withColumn("__file", _shard_path()).join(F.broadcast(names), "__file").drop("__file")
        rows.repartitionById(len(groups), F.col("__group")).write.option("compression", "zstd").partitionBy("__group").parquet(f"{self.path}/{folder}")
        merged = self._written(folder)

        def change(m: Manifest) -> list[Shard] | None:
            return [*(s for s in m.shards if s.path not in where), *merged] if where.keys() <= {s.path for s in m.shards} else None

        new = self._publish(change)
        if new is None:
            self._fs.delete(self._path(folder), True)
        return new or self.manifest()

    def settle(self) -> Manifest:
        """Compacts until no tier is full; every merge leaves fewer shards, so this ends."""
        while merge_groups((before := self.manifest()).shards, self.target, self.fanout, self.small):
            self.compact()
        return before

    def vacuum(self, keep: int = 1, grace_s: float = GRACE_S) -> int:
        """Gives up all versions but the last `keep`: their manifests go, and the shards that no kept version names.

        Files that no version names at all may belong to a writer that hasn't committed yet; they go only
        grace_s seconds after they were written. Returns how many data files went.
        """
        last, gone = self.version(), 0
        found = sorted(int(m[1]) for n, _ in self._list("manifest") if (m := re.fullmatch(r"v(\d+)\.json", n)))
        old, kept = [v for v in found if v <= last - keep], [v for v in found if v > last - keep]
        used = {s.path for v in kept for s in self.manifest(v).shards}
        known = {s.path for v in old for s in self.manifest(v).shards}
        for v in old:
            self._fs.delete(self._path(f"manifest/v{v:010d}.json"), False)
        now = time.time() * 1000
        for run, _ in self._list("data"):
            inner = [n for n, _ in self._list(f"data/{run}")]
            for folder in [f"data/{run}", *(f"data/{run}/{n}" for n in inner if "=" in n)]:
                for status in self._fs.listStatus(self._path(folder)):
                    p = f"{folder}/{status.getPath().getName()}"
                    if p.endswith(".parquet") and p not in used and (p in known or now - status.getModificationTime() > grace_s * 1000):
                        self._fs.delete(self._path(p), False)
                        gone += 1
        return gone

    # -- reading

    def _open(self, paths, schema: str | None) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType([])
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        return self._open([s.path for s in m.shards], m.schema)

    def read_with_shards(self) -> DataFrame:
        """The rows of the last version, with shard_no (place in the manifest), shard_rows and version."""
        m = self.manifest()
        names = self.spark.createDataFrame([(s.path, k, s.rows, m.version) for k, s in enumerate(m.shards)], "__file string, shard_no long, shard_rows long, version long")
        rows = self._open([s.path for s in m.shards], m.schema).drop("shard_no", "shard_rows", "version")
        if not m.shards:
            return rows.selectExpr("*", "cast(null as bigint) shard_no", "cast(null as bigint) shard_rows", "cast(null as bigint) version")
        return rows.withColumn("__file", _shard_path()).join(F.broadcast(names), "__file").drop("__file")


def shard_arrivals(docs: DataFrame, path: str, arrivals: int = 4, target: int = TARGET, fanout: int = FANOUT, small: int = SMALL, clean: bool = True) -> ShardStore:
    """Appends docs in `arrivals` parts, dealt by a hash of their id, and compacts after each; docs is read once.

    Every row lands in exactly one shard, with all its columns (their names may be any but __file, __group and
    __part); nulls, empty and very long texts, repeated rows and ties are kept as they are. An empty table
    makes a store with a schema and no shards. With clean, only the last version is kept after each arrival;
    without, all stay readable.
    """
    store = ShardStore(docs.sparkSession, path, target, fanout, small)
    staged = store.stage(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int"))
    for k in range(arrivals):
        store.add(staged.get(k, []), docs.schema)
        store.settle()
        if clean:
            store.vacuum()
    return store
