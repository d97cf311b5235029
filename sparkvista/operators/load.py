"""The load of businesses, photos and reviews as one operation over three tables.

A load stages the new rows of each table in a folder of its own, in the order businesses, photos, reviews, and then
writes one commit record, which names the folders of all three tables. What a reader sees is the newest complete
record: a load that dies before its record leaves the old state, whatever it has staged. Outcomes are counted by
the jobs that write.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import schema
from ..sources.readers import read_records
from .ingest import ingest_businesses, ingest_photos, ingest_reviews

OUTCOMES = ("inserted", "skipped", "orphaned", "error")
_REVIEW = T.StructType([T.StructField(f.name, T.DateType() if f.name == "date" else f.dataType) for f in schema.REVIEW])
#: Tables in the order in which they are loaded: schema, key.
TABLES: dict[str, tuple[T.StructType, str]] = {"businesses": (schema.BUSINESS, "business_id"), "photos": (schema.PHOTO, "photo_id"), "reviews": (_REVIEW, "review_id")}


class LoadConflict(RuntimeError):
    """Another load has committed since this one began; run it again."""


@dataclass
class State:
    """A commit: its number, and the folders of each table."""

    version: int = 0
    folders: dict[str, list[str]] = field(default_factory=lambda: {t: [] for t in TABLES})
    counts: dict[str, dict[str, int]] = field(default_factory=dict)


class Warehouse:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str) -> tuple[object, object]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def _record(self, version: int) -> State | None:
        """None for a record that was not written to its end."""
        fs, p = self._fs(f"{self.path}/_commits/{version:012}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return State(version, found["folders"], found["counts"])

    def state(self) -> State:
        """The newest complete commit; an empty one before the first."""
        for version in reversed(self._versions()):
            if (found := self._record(version)) is not None:
                return found
        return State()

    def table(self, name: str, state: State | None = None, more: tuple[str, ...] = ()) -> DataFrame:
        """A table as of a state (the newest one), with staged folders."""
        folders = [*(state or self.state()).folders[name], *more]
        kind = TABLES[name][0]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def _commit(self, old: State, folders: dict[str, list[str]], counts: dict[str, dict[str, int]]) -> State:
        """Creates the next record, which fails if another load has; an unfinished record's number isn't used again."""
        if self.state().version != old.version:
            raise LoadConflict(f"{self.path} is at version {self.state().version}, this load began at {old.version}")
        version = max([0, *self._versions()]) + 1
        fs, p = self._fs(f"{self.path}/_commits/{version:012}.json")
        try:
            stream = fs.create(p, False)
        except Exception as e:  # Py4J's error of a file that exists
            raise LoadConflict(f"version {version} of {self.path} exists") from e
        stream.write(bytearray(json.dumps({"folders": folders, "counts": counts}).encode()))
        stream.close()
        return State(version, folders, counts)

    def _stage(self, name: str, rows: DataFrame) -> tuple[str, dict[str, int]]:
        """Writes the inserted rows; the same job counts all outcomes where its tasks write, so that a task that runs again counts once."""
        seen, folder = Observation(), f"{self.path}/{name}/{uuid.uuid4().hex}"
        found = rows.observe(seen, *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
        found.filter("outcome = 'inserted'").select(*TABLES[name][0].names).write.parquet(folder)
        return folder, {o: int(seen.get[o]) for o in OUTCOMES}

    def load(self, businesses: DataFrame | None = None, photos: DataFrame | None = None, reviews: DataFrame | None = None, after: Callable[[str], None] = lambda step: None) -> State:
        """Loads raw records (with _ordinal, as read_records() gives them) of any of the tables, and commits once.

        Keys that are there are skipped, so that a second run inserts nothing; photos and reviews may belong to
        businesses of the same load. Nulls count as absent fields; several records of a key insert the first;
        an empty table stages an empty folder, a missing one nothing. `after` is told of each step.
        """
        old = self.state()
        folders, counts = {t: list(f) for t, f in old.folders.items()}, {}
        staged: dict[str, tuple[str, ...]] = {}
        for name, raw in (("businesses", businesses), ("photos", photos), ("reviews", reviews)):
            if raw is None:
                continue
            key = TABLES[name][1]
            loaded = self.table(name, old).select(key)
            known = self.table("businesses", old, staged.get("businesses", ())).select("business_id")
            rows = ingest_businesses(raw, loaded) if name == "businesses" else ingest_photos(raw, known, loaded) if name == "photos" else ingest_reviews(raw, known, loaded)
            folder, counts[name] = self._stage(name, rows)
            staged[name] = (folder,)
            folders[name].append(folder)
            after(name)
        state = self._commit(old, folders, counts)
        after("commit")
        return state

    def load_files(self, businesses: str | None = None, photos: str | None = None, reviews: str | None = None, **options: object) -> State:
        """load() of files of JSON arrays or lines; a path that does not exist is a FileNotFoundError, and nothing is staged."""
        paths = {"businesses": (businesses, schema.BUSINESS), "photos": (photos, schema.PHOTO), "reviews": (reviews, schema.REVIEW)}
        return self.load(**{n: read_records(self.spark, p, kind) for n, (p, kind) in paths.items() if p is not None}, **options)

    def counts(self) -> dict[str, int]:
        return {t: self.table(t).count() for t in TABLES}

    def vacuum(self) -> int:
        """Removes staged folders that no commit names; run it while no load runs. Their number."""
        named = {f.rsplit("/", 1)[1] for v in self._versions() if (s := self._record(v)) is not None for fs in s.folders.values() for f in fs}
        gone = 0
        for name in TABLES:
            fs, p = self._fs(f"{self.path}/{name}")
            for status in fs.listStatus(p) if fs.exists(p) else []:
                if status.getPath().getName() not in named:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone


def outcome_rows(spark: SparkSession, state: State) -> DataFrame:
    """(table_name, outcome, records) of the load that made a state."""
    rows = [(t, o, n) for t, found in state.counts.items() for o, n in found.items()]
    return spark.createDataFrame(rows, "table_name string, outcome string, records long")


def main(args: list[str]) -> int:
    """BUSINESSES PHOTOS REVIEWS WAREHOUSE: loads three files and prints what came of their records."""
    if len(args) != 4:
        print(main.__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    house = Warehouse(spark, args[3])
    try:
        state = house.load_files(*args[:3])
    except FileNotFoundError as e:
        print(f"not found: {e}")
        return 1
    for name, found in state.counts.items():
        print(name, ", ".join(f"{o} {n}" for o, n in found.items()))
    print("rows:", ", ".join(f"{t} {n}" for t, n in house.counts().items()))
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
