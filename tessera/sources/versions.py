"""Tables that grow by commits: files that stay as they were written, and manifests that say which of them count.

Under a path, ``<table>/seq=<n>/run=<id>`` holds what commit n wrote and ``versions/<n>.json`` lists the folders of each table as of then; the greatest number is what readers see. A commit writes its files, then its
manifest beside the others, and renames it into place, which fails if that version is there already. So readers see all of a commit or nothing of it, at no moment is there no table, a writer that breaks off leaves
files that nobody reads, and of two writers one gets a ``Conflict``. What a commit costs depends on what it brings. (On object stores without an atomic rename, one writer at a time.)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        store, place = self._folder(f"{self.path}/versions")
        if not store.exists(place):
            return 0
        names = [s.getPath().getName() for s in store.listStatus(place)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """tables: name -> folders; schemas: name -> JSON; note: what commits have left there."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "schemas": {}, "note": {}}
        store, place = self._folder(f"{self.path}/versions/{version:09d}.json")
        stream = store.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, changes: Mapping[str, DataFrame], replace: Iterable[str] = (), note: Mapping | None = None) -> int:
        """Adds rows to tables, in place of what those in ``replace`` held; returns the version."""
        before = self.version()
        base, number, run = self.manifest(before), before + 1, f"r{uuid.uuid4().hex}"
        tables = {k: ([] if k in replace else v) for k, v in base["tables"].items()}
        schemas = dict(base["schemas"])
        for name, df in changes.items():
            folder = f"seq={number}/run={run}"
            df.write.parquet(f"{self.path}/{name}/{folder}")
            tables[name] = [*tables.get(name, []), folder]
            known = StructType.fromJson(json.loads(schemas[name])) if name in schemas else StructType()
            fields = {f.name: f for f in known} | {f.name: f for f in df.schema if f.name not in known.fieldNames()}
            schemas[name] = StructType(list(fields.values())).json()
        self._publish(number, {"tables": tables, "schemas": schemas, "note": base["note"] | dict(note or {})})
        return number

    def _publish(self, number: int, manifest: dict) -> None:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        store, draft = self._folder(f"{self.path}/versions/.{uuid.uuid4().hex}")
        store.mkdirs(draft.getParent())
        out = store.create(draft, True)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.NONE
        final = self._folder(f"{self.path}/versions/{number:09d}.json")[1]
        try:
            jvm.FileContext.getFileContext(store.makeQualified(final).toUri(), self.spark._jsc.hadoopConfiguration()).rename(store.makeQualified(draft), store.makeQualified(final), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {number} of {self.path} is there already") from e
            raise

    def read(self, name: str, since: int = 0, version: int | None = None) -> DataFrame | None:
        """Rows of the commits after since, with the number of their commit (seq); None if there are none."""
        m = self.manifest(version)
        folders = [f for f in m["tables"].get(name, []) if int(f.split("/")[0].removeprefix("seq=")) > since]
        if not folders:
            return None
        base = f"{self.path}/{name}"
        schema = StructType.fromJson(json.loads(m["schemas"][name])).add("seq", LongType()).add("run", StringType())
        return self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders)).drop("run")

    def empty(self, name: str) -> DataFrame:
        """No rows of a table that some commit has written."""
        schema = StructType.fromJson(json.loads(self.manifest()["schemas"][name]))
        return self.spark.createDataFrame([], schema).withColumn("seq", F.lit(0).cast("long"))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but for the last ``keep``, and files of commits up to the last that none of these lists. Returns folders deleted."""
        last, gone = self.version(), 0
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        listed = {(t, f) for v in kept for t, fs in self.manifest(v)["tables"].items() for f in fs}
        for name in self.manifest(last)["tables"] if last else ():
            store, place = self._folder(f"{self.path}/{name}")
            for seq in store.listStatus(place) if store.exists(place) else ():
                if int(seq.getPath().getName().removeprefix("seq=")) > last:
                    continue  # of a commit that is under way
                for run in store.listStatus(seq.getPath()):
                    folder = f"{seq.getPath().getName()}/{run.getPath().getName()}"
                    if (name, folder) not in listed:
                        store.delete(run.getPath(), True)
                        gone += 1
        for v in range(1, (kept or [1])[0]):
            store, place = self._folder(f"{self.path}/versions/{v:09d}.json")
            store.delete(place, False)
        return gone
