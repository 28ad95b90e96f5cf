"""A record store that can be written by several at a time: immutable data folders and numbered manifests.

``<path>/data/<name>/_bucket=<n>/`` holds rows, written once and never changed. ``<path>/log/<version>.json`` lists, for each bucket of
the key's hash, the folders that make up that version. A version is claimed by creating its manifest if there is none, which one of several
writers can do; the others see what has come between and either add their folders to it (appended rows meet nobody's) or, if a bucket that they
rewrite has changed, compute again. A reader reads one manifest and sees one snapshot, whatever is written meanwhile; a writer that dies before its manifest leaves a folder
that no version lists.

A merge replaces records: only buckets that hold a changed key are read and written anew, all other buckets keep their files. A backup is a version that
``keep`` names; ``vacuum`` deletes folders that neither a kept nor a late version lists.

Rows without key are in buckets by all their columns and are never replaced. Of changes that repeat a key the caller must give one.
Later versions may have more columns; rows written before have nulls there. Driver memory: a manifest has a few paths for each bucket.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import exists, filesystem


class Conflict(Exception):
    """Another writer has changed a bucket that this one rewrites."""


@dataclass
class Manifest:
    version: int
    key: str
    buckets: int
    schema: dict
    folders: dict[str, list[str]] = field(default_factory=dict)
    note: str = ""

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = 64) -> Store:
        """An empty store; one that is there is left as it is."""
        store = cls(spark, path)
        if not exists(spark, f"{store.path}/log"):
            store._claim(Manifest(0, key, buckets, json.loads(schema.json())))
        return store

    # --- versions ---

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:012d}.json"

    def versions(self) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.path}/log")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """Of the latest version, or of the given one."""
        text = _text(self.spark, self._log(self.versions()[-1] if version is None else version))
        return Manifest(**json.loads(text))

    def _claim(self, m: Manifest) -> bool:
        """Write a version's manifest unless there is one; whether it was written."""
        return _create(self.spark, self._log(m.version), m.to_json())

    # --- reading ---

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version (the latest), or only of some buckets."""
        return self._rows(self.manifest(version), buckets)

    def _rows(self, m: Manifest, buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(m.schema)
        folders = [f"{self.path}/data/{f}/_bucket={b}" for b, fs in sorted(m.folders.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, m: Manifest, df: DataFrame) -> Column:
        """A row's bucket: by its key, or by all its columns if it has none."""
        key = F.col(m.key)
        simple = [F.to_json(F.struct(F.col(c))) for c in df.columns]
        return F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*simple)), F.lit(m.buckets)).cast("int")

    # --- writing ---

    def _write(self, m: Manifest, df: DataFrame, per_file: int = 1_000_000) -> tuple[str, list[str]]:
        """A new folder with df's rows by bucket; its name and the buckets that it has."""
        name = uuid.uuid4().hex
        fs, p = filesystem(self.spark, f"{self.path}/data/{name}")
        if "_bucket" not in df.columns:
            df = df.withColumn("_bucket", self.bucket(m, df))
        df.repartition("_bucket").write.option("maxRecordsPerFile", per_file).partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        return name, sorted(s.getPath().getName().split("=")[1] for s in fs.listStatus(p) if "=" in s.getPath().getName())

    def append(self, df: DataFrame, note: str = "append") -> int:
        """Add rows; the version that has them. Appends never conflict."""
        m = self.manifest()
        name, held = self._write(m, df)
        while True:
            folders = m.folders | {b: [*m.folders.get(b, []), name] for b in held}
            new = Manifest(m.version + 1, m.key, m.buckets, _merged(m.schema, df), folders, note)
            if self._claim(new):
                return new.version
            m = self.manifest()

    def merge(self, changes: Callable[[DataFrame], DataFrame] | DataFrame, note: str = "merge", tries: int = 10) -> int:
        """Replace the records whose keys ``changes`` has, and add its other rows; the version that has them.

        changes: rows, or a function of a snapshot that gives them; the function is called again if another writer comes first.
        """
        for _ in range(tries):
            base = self.manifest()
            rows = changes(self._rows(base)) if callable(changes) else changes
            try:
                return self._replace(base, rows, note)
            except Conflict:
                continue
        raise Conflict(f"{tries} writers came first")

    def _replace(self, base: Manifest, rows: DataFrame, note: str) -> int:
        name = f"changes-{uuid.uuid4().hex}"
        staged = f"{self.path}/data/{name}"
        rows.withColumn("_bucket", self.bucket(base, rows)).write.parquet(staged)
        new = self.spark.read.schema(StructType(rows.schema.fields).add("_bucket", "integer")).parquet(staged)
        touched = {r[0] for r in new.select("_bucket").distinct().collect()}  # no more than the store has buckets
        if not touched:
            return base.version
        old = self._rows(base, touched)
        keys = new.select(F.col(base.key).alias("_changed")).filter("_changed IS NOT NULL").distinct()
        kept = old.join(keys, F.col(base.key) == F.col("_changed"), "left_anti")
        folder, held = self._write(base, kept.withColumn("_bucket", self.bucket(base, kept)).unionByName(new, allowMissingColumns=True))
        m = base
        while True:
            changed = {b for b in map(str, touched) if m.folders.get(b) != base.folders.get(b)}
            if changed:
                raise Conflict(f"buckets {sorted(changed)} have changed since version {base.version}")
            folders = {b: fs for b, fs in m.folders.items() if int(b) not in touched} | {b: [folder] for b in held}
            done = Manifest(m.version + 1, m.key, m.buckets, _merged(m.schema, rows), folders, note)
            if self._claim(done):
                _delete(self.spark, staged)
                return done.version
            m = self.manifest()

    # --- backups ---

    def keep(self, name: str, version: int | None = None) -> int:
        """Name a version, so that it is not vacuumed; a name that is taken is an error."""
        version = self.versions()[-1] if version is None else version
        if not _create(self.spark, f"{self.path}/kept/{name}.json", json.dumps({"version": version})):
            raise FileExistsError(name)
        return version

    def kept(self, name: str) -> DataFrame:
        return self.read(json.loads(_text(self.spark, f"{self.path}/kept/{name}.json"))["version"])

    def restore(self, name: str) -> int:
        """Make a kept version's rows the latest."""
        of = json.loads(_text(self.spark, f"{self.path}/kept/{name}.json"))["version"]
        while True:
            old, m = self.manifest(of), self.manifest()
            if self._claim(Manifest(m.version + 1, old.key, old.buckets, old.schema, old.folders, f"restore {name}")):
                return m.version + 1

    def vacuum(self, last: int = 10, older_than: float = 24 * 3600) -> list[str]:
        """Delete the folders that neither kept nor the last versions list and that are older than any writer; their names.

        older_than: seconds; a folder of a writer that has not yet claimed its version is younger.
        """
        fs, p = filesystem(self.spark, f"{self.path}/kept")
        named = [json.loads(_text(self.spark, s.getPath().toString()))["version"] for s in fs.listStatus(p)] if fs.exists(p) else []
        used = {f for v in {*self.versions()[-last:], *named} for fs_ in self.manifest(v).folders.values() for f in fs_}
        data = filesystem(self.spark, f"{self.path}/data")[1]
        now = time.time()
        gone = [s.getPath().getName() for s in (fs.listStatus(data) if fs.exists(data) else []) if s.getPath().getName() not in used and s.getModificationTime() / 1000 <= now - older_than]
        for name in gone:
            _delete(self.spark, f"{self.path}/data/{name}")
        return gone


def _merged(schema: dict, df: DataFrame) -> dict:
    """schema with the columns of df that it lacks."""
    known = {f["name"] for f in schema["fields"]}
    return schema | {"fields": [*schema["fields"], *(f for f in json.loads(df.schema.json())["fields"] if f["name"] not in known and f["name"] != "_bucket")]}


def _text(spark: SparkSession, path: str) -> str:
    fs, p = filesystem(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a whole file if there is none; false if there is one. Of several at a time one succeeds."""
    folder, name = path.rsplit("/", 1)
    fs, p = filesystem(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":  # a hard link fails if the name is taken; renaming would replace it
            local = lambda q: unquote(urlparse(q).path)
            os.link(local(p.toString()), local(path))
            return True
        jvm = spark._jvm.org.apache.hadoop
        target = jvm.fs.Path(path)
        options = spark.sparkContext._gateway.new_array(jvm.fs.Options.Rename, 0)
        jvm.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(p, target, options)  # without the option to replace
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        if fs.exists(p):
            fs.delete(p, False)
