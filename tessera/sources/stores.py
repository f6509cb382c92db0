"""Stores as tables: vectors, graphs and a source cache, on any path Spark writes to."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Mapping
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.providers import Providers
from tessera.functions.retry import retried
from tessera.sources.versions import Versions


def hash_embedding(text: str, dim: int = 64) -> list[float]:
    """A deterministic unit vector of a text: hashed words, for tests and offline runs."""
    import hashlib

    v = np.zeros(dim)
    for word in text.lower().split():
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
        v[h % dim] += 1 if h >> 32 & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float] | None]] | None = None, dim: int = 64, tries: int = 2) -> DataFrame:
    """chunks with embedding and error. A batch that fails is tried again; if it still fails its rows carry the error and no vector."""

    def run(batches):
        for pdf in batches:
            texts, error = pdf["page_content"].fillna("").tolist(), None
            for _ in range(tries):
                try:
                    made, error = (model(texts) if model else [hash_embedding(t, dim) for t in texts]), None
                    break
                except Exception as e:  # what a remote model raises is unknown; it is kept in the row
                    made, error = [None] * len(texts), str(e)
            yield pdf.assign(embedding=pd.Series(made, dtype=object, index=pdf.index), error=error)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{schema}, embedding array<float>, error string")


class VectorStore:
    """vec_id, embedding and payload columns under a path, in commits (see versions): rows, and ids that are deleted from what was there before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = Versions(spark, path)

    def exists(self) -> bool:
        return self.log.version() > 0

    def add(self, rows: DataFrame) -> int:
        return self.log.commit({"rows": rows})

    def upsert(self, rows: DataFrame) -> int:
        """Adds rows in place of those of the same ids, in one commit."""
        return self.log.commit({"rows": rows, "deletes": rows.select("vec_id").distinct()})

    def scan(self, since: int = 0) -> DataFrame:
        """Rows that are there, of all commits or of those after one."""
        rows, deletes = self.log.read("rows", since), self.log.read("deletes", since)
        if rows is None:
            return self.log.empty("rows").drop("seq")
        if deletes is None:
            return rows.drop("seq")
        last = deletes.groupBy(F.col("vec_id").alias("_gone")).agg(F.max("seq").alias("_until"))
        return rows.join(last, (F.col("vec_id") == F.col("_gone")) & (F.col("seq") < F.col("_until")), "left_anti").drop("seq")

    def get(self, ids: DataFrame, dim: int | None = None) -> DataFrame:
        """Rows of the given ids (vec_id); unknown ids, and vectors of another dimension, are left out."""
        found = self.scan().join(ids.select("vec_id").distinct(), "vec_id", "left_semi")
        return found if dim is None else found.where(F.size("embedding") == dim)

    def delete(self, ids: DataFrame, into: str | None = None) -> VectorStore:
        """Without the given ids: writes the ids only. With another path, a store there of what is left, and this one as it was."""
        if into is None:
            self.log.commit({"deletes": ids.select("vec_id").distinct()})
            return self
        other = VectorStore(self.spark, into)
        other.add(self.scan().join(ids.select("vec_id").distinct(), "vec_id", "left_anti"))
        return other

    def remove(self, ids: DataFrame) -> None:
        self.delete(ids)

    def deleted_since(self, version: int) -> bool:
        return self.log.read("deletes", version) is not None

    def compact(self) -> int:
        """One commit of what is there; readers of older versions keep their files until vacuum."""
        return self.log.commit({"rows": self.scan()}, replace=("rows", "deletes"))


#: Vector stores by name; others by a dotted path.
VECTOR_STORES = Providers("vector store")
VECTOR_STORES.register("parquet", "table")(VectorStore)
GRAPH_KINDS = ("parquet", "json", "pickle")


class GraphConnector(Protocol):
    """A graph database: rows are merged by id, so sending them again changes nothing. One is made in each task."""

    def wipe(self) -> None: ...

    def merge_nodes(self, rows: list[dict]) -> None: ...

    def merge_edges(self, rows: list[dict]) -> None: ...


def send(nodes: DataFrame, edges: DataFrame, connect: Callable[[], GraphConnector], wipe: bool = False, batch: int = 1000) -> None:
    """Nodes (node_id) and edges (src, dst, type) into a graph database, nodes first, the last row of each id by its other columns, from all tasks in batches that are tried three times."""

    def last(df: DataFrame, *key: str) -> DataFrame:
        rest = F.struct(*(c for c in df.columns if c not in key))
        return df.groupBy(*key).agg(F.max(rest).alias("r")).select(*key, "r.*")

    def put(method: str) -> Callable:
        def run(rows) -> None:
            merge, held = retried(getattr(connect(), method)), []
            for r in rows:
                held.append(r.asDict(recursive=True))
                if len(held) == batch:
                    merge(held)
                    held = []
            if held:
                merge(held)

        return run

    if wipe:
        connect().wipe()
    last(nodes, "node_id").foreachPartition(put("merge_nodes"))
    last(edges, "src", "dst", "type").foreachPartition(put("merge_edges"))


class GraphStore:
    """Nodes and edges under a path, as parquet, json or pickle (one file, made by the driver, for at most MOST_PICKLED rows); all read back to the same tables."""

    MOST_PICKLED = 1_000_000

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet"):
        if kind not in GRAPH_KINDS:
            raise ValueError(f"unknown format {kind}; one of {GRAPH_KINDS}")
        self.spark, self.path, self.kind = spark, path, kind

    def save(self, nodes: DataFrame, edges: DataFrame) -> None:
        for name, df in (("nodes", nodes), ("edges", edges)):
            if self.kind == "pickle":
                rows = df.limit(self.MOST_PICKLED + 1).collect()
                if len(rows) > self.MOST_PICKLED:
                    raise ValueError(f"more than {self.MOST_PICKLED} {name}; save them as parquet")
                data = pickle.dumps([r.asDict(recursive=True) for r in rows])
                self.spark.createDataFrame([(bytearray(data),)], "data binary").write.mode("overwrite").parquet(f"{self.path}/{name}.pickle")
            else:
                df.write.mode("overwrite").format(self.kind).save(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        if self.kind == "pickle":
            wanted = [c.split()[0] for c in schema.split(", ")]
            rows = pickle.loads(self.spark.read.parquet(f"{self.path}/{name}.pickle").first().data)
            return self.spark.createDataFrame([tuple(r.get(c) for c in wanted) for r in rows], schema)
        return self.spark.read.format(self.kind).schema(schema).load(f"{self.path}/{name}")

    def nodes(self) -> DataFrame:
        n = self._read("nodes", "node_id string, type string, name string, vec_id bigint")
        return n.withColumns({"type": F.coalesce("type", F.lit("Entity")), "name": F.coalesce("name", "node_id")})

    def edges(self) -> DataFrame:
        e = self._read("edges", "src string, dst string, type string, weight double")
        return e.withColumns({"type": F.coalesce("type", F.lit("RELATED_TO")), "weight": F.coalesce("weight", F.lit(1.0))})

    def sql(self, query: str) -> DataFrame:
        """SQL over views nodes and edges."""
        return self.spark.sql(query, nodes=self.nodes(), edges=self.edges()) if "{nodes}" in query or "{edges}" in query else self._views(query)

    def _views(self, query: str) -> DataFrame:
        self.nodes().createOrReplaceTempView("nodes")
        self.edges().createOrReplaceTempView("edges")
        return self.spark.sql(query)


class GraphLog(GraphStore):
    """A graph that grows by commits of the nodes and edges that are new: merged on reading (the least type, name and vector id of a node, the sum of an edge's weights), so that a commit costs what it brings; compacted
    now and then, after which nothing is left to merge."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self.log = Versions(spark, path)

    def add(self, nodes: DataFrame, edges: DataFrame, mentions: DataFrame | None = None, note: Mapping | None = None) -> int:
        """mentions: where a node is named (node_id and whatever is known of the place); they are kept as they come."""
        return self.log.commit({"nodes": nodes, "edges": edges} | ({} if mentions is None else {"mentions": mentions}), note=note)

    def mentions(self, node_ids: DataFrame | None = None) -> DataFrame:
        """All mentions, or those of some nodes (node_id)."""
        found = self.log.read("mentions")
        found = self.log.empty("mentions") if found is None else found
        found = found.drop("seq")
        return found if node_ids is None else found.join(node_ids.select("node_id").distinct(), "node_id", "left_semi")

    def save(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.log.commit({"nodes": nodes, "edges": edges}, replace=("nodes", "edges"))

    def deltas(self) -> int:
        return len(self.log.manifest()["tables"].get("nodes", []))

    def compact(self) -> int:
        """The merged graph as one commit. What was noted stays."""
        return self.log.commit({"nodes": self._merged("nodes"), "edges": self._merged("edges")}, replace=("nodes", "edges"), note={"compact": True})

    def _merged(self, name: str) -> DataFrame | None:
        rows = self.log.read(name)
        if rows is None:
            return None
        if name == "nodes":
            return rows.groupBy("node_id").agg(*(F.min(c).alias(c) for c in rows.columns if c not in ("node_id", "seq")))
        return rows.groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight"))

    def _read(self, name: str, schema: str) -> DataFrame:
        m = self.log.manifest()
        if m["note"].get("compact") and len(m["tables"].get(name, [])) == 1:
            return self.log.read(name).drop("seq")
        found = self._merged(name)
        return self.spark.createDataFrame([], schema) if found is None else found


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Both tables, the row of greatest order of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return old.unionByName(new).withColumn("_n", place).where("_n = 1").drop("_n")


def cache_key(source_type: Column, identifier: Column) -> Column:
    return F.md5(F.concat_ws(":", source_type, identifier))


def cache_valid(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Entries that are no older than their time to live (0: none expires), the newest of each key."""
    c = cache.withColumn("cache_key", cache_key(F.col("source_type"), F.col("identifier")))
    if ttl_seconds > 0:
        c = c.where((now.cast("double") - F.col("cached_at").cast("double")) <= ttl_seconds)
    place = F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc("cached_at"), "entry_id"))
    return c.withColumn("_n", place).where("_n = 1").drop("_n")


def cache_clear(cache: DataFrame, source_type: str | None = None, identifier: str | None = None) -> DataFrame:
    """What is left after clearing one entry, a type, or all."""
    if source_type is None:
        return cache.limit(0)
    goes = F.col("source_type") == source_type
    return cache.where(~(goes & (F.col("identifier") == identifier) if identifier is not None else goes))
