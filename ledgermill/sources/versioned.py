"""Tables that change by commits: Parquet parts, a manifest a version, an atomic next number.

A commit writes its parts into new files and then claims the next version number by
renaming its manifest into place, which fails if another writer has claimed it.  So a
version shows all changes of its commit or none, a writer that read an older version
learns of the conflict, and every earlier version stays readable.

A keyed table is changed by parts of upserted rows and of deleted keys; reading it takes
the last part's row of each key.  ``compact`` writes the result as one part again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE, UPSERT, DELETE, APPEND = "base", "upsert", "delete", "append"


class Conflict(Exception):
    """Another writer has committed since the version that this one read."""


@dataclass(frozen=True)
class Part:
    """Rows that lie in a file of a table already and belong to it once a commit names them."""

    path: str
    rows: DataFrame


@dataclass
class Commit:
    """Changes to make together; ``note`` is kept with the version."""

    note: str = ""
    changes: list[tuple[str, str, DataFrame | Part]] = field(default_factory=list)

    def replace(self, table: str, rows: DataFrame | Part) -> Commit:
        """``rows`` are the whole table from now on."""
        self.changes.append((table, BASE, rows))
        return self

    def upsert(self, table: str, rows: DataFrame | Part) -> Commit:
        """Rows put in place of those with their keys; of several with one key any may stand."""
        self.changes.append((table, UPSERT, rows))
        return self

    def append(self, table: str, rows: DataFrame | Part) -> Commit:
        """Further rows of a table that is only ever appended to; its keys are not looked at."""
        self.changes.append((table, APPEND, rows))
        return self

    def delete(self, table: str, keys: DataFrame) -> Commit:
        self.changes.append((table, DELETE, keys))
        return self


class VersionedTables:
    """The tables under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    # --- manifests: small files, read and written through Hadoop's file systems ---------

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of all commits, ascending."""
        fs, folder = self._fs(), self._at("_versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def latest(self) -> int:
        """0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {"version": 0, "note": "", "tables": {}}
        stream = self._fs().open(self._at(f"_versions/v{version:020d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _claim(self, manifest: dict) -> None:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        fs, waiting = self._fs(), self._at(f"_waiting/{uuid.uuid4().hex}.json")
        stream = fs.create(waiting)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        fs.mkdirs(self._at("_versions"))
        rename = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(waiting, self._at(f"_versions/v{manifest['version']:020d}.json"), rename)  # never overwrites
        except Exception as error:
            if "already exists" in str(error) or "FileAlreadyExists" in str(error):
                raise Conflict(f"version {manifest['version']} is taken") from error
            raise

    # --- reading and committing ---------------------------------------------------------

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table at a version, the latest by default."""
        entry = self.manifest(self.latest() if version is None else version)["tables"][table]
        schema, keys = StructType.fromJson(entry["schema"]), self.keys[table]
        parts = entry["parts"]
        load = lambda p: self.spark.read.schema(schema if p["kind"] != DELETE else StructType([schema[k] for k in keys])).parquet(p["path"])
        if all(p["kind"] in (BASE, APPEND) for p in parts):
            return self.spark.read.schema(schema).parquet(*[p["path"] for p in parts])
        rows = None
        for turn, p in enumerate(parts):
            one = load(p)
            whole = F.struct(*[F.col(f"`{f.name}`") for f in schema]) if p["kind"] != DELETE else F.lit(None).cast(schema)
            one = one.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(turn).alias("turn"), whole.alias("row"))
            rows = one if rows is None else rows.union(one)
        # one row a key and part: the later part stands
        last = rows.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.max_by("row", "turn").alias("row"))
        return last.where("row is not null").select("row.*")

    def write(self, table: str, rows: DataFrame) -> Part:
        """Writes rows that a later commit takes in; until then no reader sees them."""
        path = f"{self.path}/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return Part(path, self.spark.read.schema(rows.schema).parquet(path))

    def commit(self, commit: Commit, read_version: int | None = None) -> int:
        """Writes the changes and claims the next version; raises ``Conflict`` if one came after ``read_version``."""
        before = self.latest() if read_version is None else read_version
        held = self.manifest(before)
        tables = dict(held["tables"])
        for table, kind, rows in commit.changes:
            if kind == DELETE:
                rows = rows.select(*self.keys[table]).distinct()
            written = rows if isinstance(rows, Part) else self.write(table, rows)
            part, rows = {"path": written.path, "kind": kind}, written.rows
            if kind == BASE:
                tables[table] = {"schema": rows.schema.jsonValue(), "parts": [part]}
            else:
                entry = tables[table]
                tables[table] = entry | {"parts": [*entry["parts"], part]}
        self._claim({"version": before + 1, "note": commit.note, "tables": tables})
        return before + 1

    def compact(self, table: str) -> int:
        """The table as a single part; earlier versions keep theirs."""
        at = self.latest()
        return self.commit(Commit(f"compact {table}").replace(table, self.read(table, at)), at)

    def history(self) -> list[tuple[int, str]]:
        return [(v, self.manifest(v)["note"]) for v in self.versions()]
