"""Tables kept as snapshots: results are written beside the old ones, and a manifest switches to them last.

A store is a folder. Each version of it is one small manifest file that names the files of every table; readers follow the newest.
A commit writes its tables into new folders first and its manifest at the very end, under a name that only one writer can take. So
a job that dies earlier leaves the old tables as they were, readers never see half of a commit, and of two writers that started
from the same version one gets ``Conflict``.

A commit belongs to a run: an application and a number that rises with every run. A number that is not above the last one applied
changes nothing, so a job or a streaming batch that is repeated, also after a restart, is harmless.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit took the version first."""


@dataclass(frozen=True)
class Layout:
    """How a table lies in its folder: partition columns, and buckets by a key, sorted by it."""

    partition_by: tuple[str, ...] = ()
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0


@dataclass(frozen=True)
class Entry:
    paths: tuple[str, ...]
    schema: str
    layout: Layout = field(default_factory=Layout)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    tables: Mapping[str, Entry] = field(default_factory=dict)
    applied: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Commit:
    version: int
    applied: bool


class SnapshotStore:
    """Versioned tables under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop
        self._path = lambda name: hadoop.fs.Path(f"{self.root}/{name}")
        configuration = spark._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(configuration)
        self._status = lambda file: (at := hadoop.fs.Path(file)).getFileSystem(configuration).getFileStatus(at)
        self._context = hadoop.fs.FileContext.getFileContext(self._files.getUri(), configuration)

    # --- reading -------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path("_manifests")
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of ``version``, by default of the newest; an empty one if there is none."""
        if version is None:
            versions = self.versions()
            if not versions:
                return Manifest()
            version = versions[-1]
        stream = self._files.open(self._path(_name(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return _read(text)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as of ``version``, by default the newest. Only this version's files are listed."""
        return self.open(self.manifest(version).tables[name])

    def open(self, entry: Entry) -> DataFrame:
        if entry.layout.buckets:
            return self.spark.table(self._registered(entry))
        return self.spark.read.schema(StructType.fromJson(json.loads(entry.schema))).parquet(*entry.paths)

    def _registered(self, entry: Entry) -> str:
        """Name of the catalog table for bucketed files: only the catalog knows about buckets. It is made again in a new session."""
        name = _catalog_name(entry.paths[0])
        if not self.spark.catalog.tableExists(name):
            layout = entry.layout
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(entry.schema)))
            partitioned = f"PARTITIONED BY ({', '.join(layout.partition_by)})" if layout.partition_by else ""
            keys = ", ".join(layout.bucket_by)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet {partitioned} CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                f"INTO {layout.buckets} BUCKETS LOCATION '{entry.paths[0]}'"
            )
            if layout.partition_by:
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return name

    def file_bytes(self, frame: DataFrame) -> int:
        """Size of the files that ``frame`` is read from; 0 if there are none."""
        return sum(self._status(file).getLen() for file in frame.inputFiles())

    # --- writing -------------------------------------------------------------------------------------------------

    def commit(
        self, run: tuple[str, int], tables: Mapping[str, DataFrame], appended: Mapping[str, DataFrame] | None = None,
        layouts: Mapping[str, Layout] | None = None, base: int | None = None,
    ) -> Commit:
        """Replace ``tables`` and add the rows of ``appended`` in one step; all other tables stay.

        ``base`` is the version that the frames were computed from (default: the newest when the commit begins). A commit made
        since then is a ``Conflict``: the frames would undo it.
        """
        now = self.manifest(base)
        if self.is_applied(run):
            return Commit(self.versions()[-1], False)
        entries = {name: self.stage(name, frame, (layouts or {}).get(name, Layout())) for name, frame in tables.items()}
        for name, frame in (appended or {}).items():
            new = self.stage(name, frame)
            old = now.tables.get(name, replace(new, paths=()))
            if old.layout.buckets:
                raise ValueError(f"{name} is bucketed: replace it")
            entries[name] = replace(old, paths=(*old.paths, *new.paths))
        return self.publish(run, entries, now)

    def publish(self, run: tuple[str, int], entries: Mapping[str, Entry], now: Manifest | None = None) -> Commit:
        """Switch to staged tables, all at once; tables that are not among them stay."""
        now = now or self.manifest()
        self._switch(Manifest(now.version + 1, {**now.tables, **entries}, {**now.applied, run[0]: run[1]}))
        return Commit(now.version + 1, True)

    def is_applied(self, run: tuple[str, int]) -> bool:
        return self.manifest().applied.get(run[0], -1) >= run[1]

    def stage(self, name: str, frame: DataFrame, layout: Layout = Layout()) -> Entry:
        """Write a table that no reader sees before it is published."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        writer = (frame.repartition(layout.buckets, *layout.bucket_by) if layout.buckets else frame).write
        if layout.partition_by:
            writer = writer.partitionBy(*layout.partition_by)
        if layout.buckets:
            # Repartitioned by the buckets' own hash: one file per bucket and partition.
            writer = writer.bucketBy(layout.buckets, *layout.bucket_by).sortBy(*layout.bucket_by)
            writer.option("path", path).format("parquet").saveAsTable(_catalog_name(path))
        else:
            writer.parquet(path)
        kept = [f for f in frame.schema if f.name not in layout.partition_by]
        kept += [f for c in layout.partition_by for f in frame.schema if f.name == c]
        return Entry((path,), StructType(kept).json(), layout)

    def _switch(self, manifest: Manifest) -> None:
        """Publish the manifest. The rename takes the version's name or fails; the file is complete before it has that name."""
        draft = self._path(f"_manifests/.draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            out.close()
        rename = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark._sc._gateway.new_array(rename, 0)
        try:
            self._context.rename(draft, self._path(_name(manifest.version)), options)
        except Exception as error:
            self._files.delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                raise Conflict(f"version {manifest.version} was committed by another run") from None
            raise

    def compact(self, name: str, run: tuple[str, int]) -> Commit:
        """Rewrite a table of many appended folders as one."""
        version = self.manifest().version
        return self.commit(run, {name: self.read(name, version)}, base=version)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the manifests before the last ``keep`` and all table folders that no kept manifest names: those of old versions and
        of commits that died. Not to be run beside a commit, whose folders no manifest names yet."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {p for v in kept for e in self.manifest(v).tables.values() for p in e.paths}
        dropped = []
        for table in self._files.listStatus(self._path("")) if versions else []:
            if table.getPath().getName().startswith(("_", ".")) or not table.isDirectory():
                continue
            for folder in self._files.listStatus(table.getPath()):
                path = f"{self.root}/{table.getPath().getName()}/{folder.getPath().getName()}"
                if path not in used:
                    self.spark.sql(f"DROP TABLE IF EXISTS {_catalog_name(path)}")
                    self._files.delete(folder.getPath(), True)
                    dropped.append(path)
        for version in set(versions) - set(kept):
            self._files.delete(self._path(_name(version)), False)
        return dropped


def _name(version: int) -> str:
    return f"_manifests/v{version:020d}.json"


def _catalog_name(path: str) -> str:
    return f"snapshot_{path.rsplit('/', 1)[1]}"


def _read(text: str) -> Manifest:
    found = json.loads(text)
    entries = {}
    for name, entry in found["tables"].items():
        layout = entry["layout"]
        entries[name] = Entry(
            tuple(entry["paths"]), entry["schema"], Layout(tuple(layout["partition_by"]), tuple(layout["bucket_by"]), layout["buckets"])
        )
    return Manifest(found["version"], entries, found["applied"])

