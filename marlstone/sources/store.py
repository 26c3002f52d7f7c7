"""Tables on a shared file system: Parquet files and a chain of manifests.

A commit writes its files first and then adds the next manifest, whose name is
claimed by an exclusive rename. Files that no manifest names don't exist for
readers, so a commit over several tables is seen whole or not at all, and a writer
that dies leaves nothing behind but unused files. The manifest also keeps the
clock and the table definitions. One process or several may write: whoever finds
its manifest's name taken checks its reads again and tries the next.

Each table has base files (one version a key, written by a bulk load or by
``compact``) and newer versions on top. A read joins the two on the key. When more
than ``MOST_DELTAS`` commits lie on a table, their files are written again as one
folder that keeps every version, so a read lists a bounded number of folders and
earlier snapshots stay readable.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from marlstone.functions.routing import shard_of, shard_of_key
from marlstone.sources.catalog import Catalog, TableDef
from marlstone.sources.versions import META, latest, overlay, versions


#: Folders of newer versions that a table has at most after a commit.
MOST_DELTAS = 16
MERGED_FILES = 64


class ManifestTaken(RuntimeError):
    """Another writer has added this manifest."""


@dataclass
class Files:
    base: list[str] = field(default_factory=list)
    base_ts: int = 0
    #: [path, last commit timestamp, first commit timestamp], oldest first
    deltas: list[list] = field(default_factory=list)


@dataclass
class Manifest:
    number: int = 0
    clock: int = 0
    catalog: Catalog = field(default_factory=Catalog)
    files: dict[str, Files] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(
            {
                "number": self.number,
                "clock": self.clock,
                "next_id": self.catalog.next_id,
                "tables": [t.to_dict() for t in self.catalog.tables.values()],
                "files": {name: vars(f) for name, f in self.files.items()},
            }
        )

    @staticmethod
    def from_json(text: str) -> Manifest:
        d = json.loads(text)
        catalog = Catalog({t["name"]: TableDef.from_dict(t) for t in d["tables"]}, d["next_id"])
        return Manifest(d["number"], d["clock"], catalog, {n: Files(**f) for n, f in d["files"].items()})


class Folder:
    """The few file operations a manifest needs, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(self.conf)
        self.fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def manifests(self) -> list[int]:
        found = self.fs.listStatus(self._path(f"{self.root}/manifests"))
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> str:
        stream = self.fs.open(self._path(self._name(number)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def add(self, number: int, text: str) -> None:
        waiting = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(waiting)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self.fs.makeQualified(self._path(self._name(number)))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(waiting), target, options)
        except Exception as e:
            self.fs.delete(waiting, False)
            if "FileAlreadyExists" in str(e):
                raise ManifestTaken(str(number)) from e
            raise

    def _name(self, number: int) -> str:
        return f"{self.root}/manifests/{number:012d}.json"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.folder = Folder(spark, root)
        self.root = self.folder.root
        self._manifests: dict[int, Manifest] = {}
        if not self.folder.manifests():
            try:
                self.folder.add(0, Manifest().to_json())
            except ManifestTaken:
                pass

    def manifest(self, number: int | None = None) -> Manifest:
        number = self.folder.manifests()[-1] if number is None else number
        if number not in self._manifests:
            self._manifests[number] = Manifest.from_json(self.folder.read(number))
        return Manifest.from_json(self._manifests[number].to_json())

    def publish(self, manifest: Manifest) -> Manifest:
        """Add ``manifest`` as the successor of the one it was made from."""
        manifest.number += 1
        self.folder.add(manifest.number, manifest.to_json())
        return manifest

    def create_table(self, table: TableDef) -> TableDef:
        while True:
            manifest = self.manifest()
            made = manifest.catalog.create(table)
            manifest.files[made.name] = Files()
            try:
                self.publish(manifest)
                return made
            except ManifestTaken:
                continue

    def log_schema(self, table: TableDef) -> StructType:
        return StructType([*[StructField(f.name, f.dataType) for f in table.schema], StructField("_pk", StringType()), StructField("_commit_ts", LongType()), StructField("_deleted", BooleanType())])

    def write_files(self, table: TableDef, rows: DataFrame) -> str:
        """Write versions; returns the folder. Rows of one shard lie together if the table has shards."""
        path = f"{self.root}/data/{table.table_id}/{uuid.uuid4().hex}"
        rows = rows.select(*table.names, *META)
        if table.shards > 1:
            rows.withColumn("_shard", shard_of(F.col("_pk"), table.shards)).write.partitionBy("_shard").parquet(path)
        else:
            rows.write.parquet(path)
        return path

    def stage(self, rows: DataFrame) -> str:
        """Write rows that no manifest names yet; returns the folder."""
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def read_staged(self, table: TableDef, path: str) -> DataFrame:
        return self.spark.read.schema(self.log_schema(table)).parquet(path)

    def sweep(self) -> None:
        """Delete what transactions have staged. To be called while none is open and no lazy result of one is left."""
        self.folder.fs.delete(self.folder._path(f"{self.root}/staged"), True)

    def read_files(self, table: TableDef, paths: list[str], key: str | None = None) -> DataFrame:
        """Versions in some folders; with ``key``, those of the key's shard only."""
        schema = self.log_schema(table)
        if not paths:
            return self.spark.createDataFrame([], schema)
        if table.shards > 1:
            whole = StructType([*schema.fields, StructField("_shard", schema["_commit_ts"].dataType)])
            parts = [self.spark.read.schema(whole).parquet(p) for p in paths]
            if key is not None:
                parts = [p.where(F.col("_shard") == shard_of_key(key, table.shards)) for p in parts]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out.drop("_shard")
        return self.spark.read.schema(schema).parquet(*paths)

    def bulk_load(self, name: str, rows: DataFrame) -> int:
        """Replace an empty table's content with ``rows``, whose keys must be unique and not null."""
        while True:
            manifest = self.manifest()
            table = manifest.catalog.get(name)
            files = manifest.files[name]
            if files.base or files.deltas:
                raise ValueError(f"table {name} is not empty")
            ts = manifest.clock + 1
            typed = rows.select(*[F.col(c.name).cast(c.type.spark).alias(c.name) for c in table.columns])
            path = self.write_files(table, versions(typed, table.primary_key, ts))
            keys = self.read_files(table, [path]).groupBy("_pk").agg(F.count(F.lit(1)).alias("n"))
            if keys.where("_pk IS NULL OR n > 1").limit(1).count():
                raise ValueError(f"rows for {name} have a null or repeated key")
            files.base, files.base_ts, manifest.clock = [path], ts, ts
            try:
                self.publish(manifest)
                return ts
            except ManifestTaken:
                continue

    def snapshot_log(self, name: str, manifest: Manifest, snapshot_ts: int | None = None, key: str | None = None) -> DataFrame:
        """Live rows with their meta columns; ``key``: read no more than that key's shard and rows."""
        table, files = manifest.catalog.get(name), manifest.files[name]
        ts = manifest.clock if snapshot_ts is None else snapshot_ts
        if ts < files.base_ts:
            raise ValueError(f"versions of {name} before {files.base_ts} were compacted away")
        base = self.read_files(table, files.base, key)
        newer = [p for p, _, first in files.deltas if first <= ts]
        delta = self.read_files(table, newer, key)
        if key is not None:
            base, delta = base.where(F.col("_pk") == key), delta.where(F.col("_pk") == key)
        if not newer:
            return base
        return overlay(base, latest(delta, ts).select(*base.columns))

    def read(self, name: str, *, as_of: int | None = None, manifest: Manifest | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        return self.snapshot_log(name, manifest, as_of).select(*manifest.catalog.get(name).names)

    def changed_since(self, name: str, manifest: Manifest, ts: int) -> DataFrame | None:
        """Keys of versions later than ``ts``; None if there are none."""
        paths = [p for p, last, _ in manifest.files[name].deltas if last > ts]
        if not paths and manifest.files[name].base_ts <= ts:
            return None
        base = manifest.files[name].base if manifest.files[name].base_ts > ts else []
        return self.read_files(manifest.catalog.get(name), paths + base).where(F.col("_commit_ts") > ts).select("_pk")

    def compact(self, name: str) -> None:
        """Write the newest versions as new base files. Older snapshots of the table can't be read afterwards."""
        while True:
            manifest = self.manifest()
            table, files = manifest.catalog.get(name), manifest.files[name]
            path = self.write_files(table, self.snapshot_log(name, manifest))
            manifest.files[name] = Files([path], max([files.base_ts, *(last for _, last, _ in files.deltas)]), [])
            try:
                self.publish(manifest)
                return
            except ManifestTaken:
                continue

    def merge_deltas(self, name: str, most: int = MOST_DELTAS) -> bool:
        """Write the versions of all newer folders as one, if there are more than ``most``. Snapshots read as before; the old folders stay for readers that began earlier."""
        while True:
            manifest = self.manifest()
            deltas = manifest.files[name].deltas
            if len(deltas) <= most:
                return False
            table = manifest.catalog.get(name)
            path = self.write_files(table, self.read_files(table, [p for p, _, _ in deltas]).coalesce(MERGED_FILES))
            manifest.files[name].deltas = [[path, max(last for _, last, _ in deltas), min(first for _, _, first in deltas)]]
            try:
                self.publish(manifest)
                return True
            except ManifestTaken:
                continue
