"""Tables in versions that several runs can write: data in folders of Parquet files, a manifest a version, optimistic commits.

`path/_data/<id>/` holds what one write made; `path/_versions/<n>.json` lists the folders of version n. A version is there when its manifest is,
which appears whole and only if no other run has put one in its place. So a crash at any step leaves the old version or the new one, a
reader sees one version throughout, and of two writers that began with the same version one wins; the other goes on from the winner's.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dedup import first_wins
from ..tables import unused

#: Folders of a version from which on a commit that replaces rows lays them together, and tries of a commit.
FOLDERS, TRIES = 16, 50


class Conflict(RuntimeError):
    """A commit lost to others too often."""


@dataclass
class Manifest:
    version: int = 0
    folders: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)
    rows: int = 0
    at: float = 0.0


class Folder:
    """What this module asks of a store: Hadoop's file system, where a rename onto a file that is there fails; a link on a local one, where it doesn't."""

    def __init__(self, spark: SparkSession, path: str):
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        at = self._path(path)
        self._fs, self._io, self._sc = at.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.commons.io.IOUtils, sc
        self.path = path.rstrip("/")
        self.local = urlsplit(path).scheme in ("", "file") and self._fs.getScheme() == "file"

    def names(self, name: str) -> list[str]:
        at = self._path(f"{self.path}/{name}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Puts a whole file in place if none is there; whether it did."""
        target, beside = self._path(f"{self.path}/{name}"), self._path(f"{self.path}/_tmp/{uuid.uuid4().hex}")
        stream = self._fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.mkdirs(target.getParent())
        try:
            if self.local:
                os.link(beside.toUri().getPath(), target.toUri().getPath())
                return True
            return not self._fs.exists(target) and self._fs.rename(beside, target)
        except FileExistsError:
            return False
        finally:
            self._fs.delete(beside, False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def age(self, name: str) -> float:
        return time.time() - self._fs.getFileStatus(self._path(f"{self.path}/{name}")).getModificationTime() / 1000


class VersionedTable:
    """A table at a path. `key` names the column that tells rows apart, `schema` (DDL) is what an empty one has.

    `append` adds rows whose key isn't there; `upsert` lets rows take the place of those with their key. Both are begun and committed apart
    where a caller asks for it (`begin`). Versions stay readable until `vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.folder, self.schema, self.key = spark, Folder(spark, path), schema, key

    def latest(self) -> int:
        return max((int(n.removesuffix(".json")) for n in self.folder.names("_versions") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.latest() if version is None else version
        return Manifest(**json.loads(self.folder.read(f"_versions/{version:012d}.json"))) if version else Manifest()

    def _of(self, folders: list[str], number: str | None = None) -> DataFrame:
        out = None
        for k, name in enumerate(folders):
            part = self.spark.read.schema(self._schema()).parquet(f"{self.folder.path}/_data/{name}")
            part = part if number is None else part.withColumn(number, F.lit(k))
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], self._schema())
            out = out if number is None else out.withColumn(number, F.lit(0))
        return out

    def _schema(self):
        return self.spark.createDataFrame([], self.schema).schema if isinstance(self.schema, str) else self.schema

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is named: each key once, as the last write that had it."""
        return self.newest(self.manifest(version).folders)

    def newest(self, folders: list[str]) -> DataFrame:
        """The rows of some folders, of each key those of the last folder that has it."""
        number = unused(self.spark.createDataFrame([], self._schema()), "number")
        rows, last = self._of(folders, number), f"{number}_"
        if len(folders) < 2:
            return rows.drop(number)
        newest = rows.groupBy(self.key).agg(F.max(number).alias(last)).withColumnRenamed(self.key, f"{last}key")
        return rows.join(newest, rows[self.key].eqNullSafe(newest[f"{last}key"]) & (rows[number] == newest[last])).drop(number, last, f"{last}key")

    def history(self) -> DataFrame:
        """Rows of a table that only appends, once for each version that has them: version, the columns, and since which version."""
        last = self.latest()
        each = [self._of(self.manifest(v).added).withColumn("since", F.lit(v)) for v in range(1, last + 1)]
        out = self._of([]).withColumn("since", F.lit(0))
        for rows in each:
            out = out.unionByName(rows)
        return out.select(F.explode(F.sequence("since", F.lit(last))).alias("version"), "*") if last else out.select(F.lit(0).alias("version"), "*")

    def write(self, rows: DataFrame) -> tuple[str, int]:
        """A folder with the rows, each key once, and their number; nobody reads it before a commit."""
        name = uuid.uuid4().hex
        rows.select(self._schema().names).write.parquet(f"{self.folder.path}/_data/{name}")
        return name, self._of([name]).count()

    def begin(self, new: DataFrame, replace: bool = False) -> Draft:
        return Draft(self, new, replace)

    def append(self, new: DataFrame, empty: bool = False) -> int:
        """Adds the rows of `new` whose key isn't there, of each key the first in order of all columns. The number of rows added."""
        return self.begin(new).commit(empty=empty)

    def upsert(self, new: DataFrame) -> int:
        return self.begin(new, True).commit()

    def vacuum(self, older_than: float = 86_400, versions: int = 1) -> list[str]:
        """Deletes versions before the last few, and folders that no version left names and that are older than so many seconds."""
        last = self.latest()
        for n in self.folder.names("_versions"):
            if int(n.removesuffix(".json")) <= last - versions:
                self.folder.delete(f"_versions/{n}")
        known = {f for v in range(max(1, last - versions + 1), last + 1) for f in self.manifest(v).folders}
        gone = [n for n in self.folder.names("_data") if n not in known and self.folder.age(f"_data/{n}") >= older_than]
        for n in gone:
            self.folder.delete(f"_data/{n}")
        return gone


class Draft:
    """A write that has begun: its data is stored, its version isn't there yet."""

    def __init__(self, table: VersionedTable, new: DataFrame, replace: bool):
        self.table, self.replace = table, replace
        self.base = table.manifest()
        rows = first_wins(new, [table.key], new.columns)
        self.name, self.rows = table.write(rows if replace else self._unknown(rows, self.base.folders))

    def _unknown(self, rows: DataFrame, folders: list[str]) -> DataFrame:
        known = self.table._of(folders).select(F.col(self.table.key).alias("known_key")).distinct()
        return rows.join(known, F.col(self.table.key).eqNullSafe(F.col("known_key")), "left_anti") if folders else rows

    def commit(self, before: Callable[[], None] = lambda: None, empty: bool = False) -> int:
        """Puts the version in place and tells how many rows it has that were not there; where another has come first, rows that it has are left out again.

        `before` is called before each try. A draft without rows makes no version,
        or with `empty` one that has what the version before has.
        """
        t = self.table
        for _ in range(TRIES):
            latest = t.manifest()
            others = [f for f in latest.folders if f not in self.base.folders]
            if others and not self.replace and self.rows:
                self.name, self.rows = t.write(self._unknown(t._of([self.name]), others))
            self.base = latest
            if not self.rows and not empty:
                return 0
            added = [self.name] if self.rows else []
            folders = [*latest.folders, *added]
            if self.replace and len(folders) > FOLDERS:
                folders = [t.write(t.newest(folders))[0]]
            made = Manifest(latest.version + 1, folders, added, self.rows, time.time())
            before()
            if t.folder.put_new(f"_versions/{made.version:012d}.json", json.dumps(made.__dict__)):
                return self.rows
        raise Conflict(f"{TRIES} commits lost")


def is_versioned(spark: SparkSession, path: str) -> bool:
    return Folder(spark, path).exists("_versions")
