"""An exact index of vectors: cells around centroids, left out of a search where the triangle inequality shows that they hold nothing near enough.

Building: centroids are fitted by k-means to at most MOST_SAMPLE vectors (those of the least hashed ids), then every vector is written to the cell of its nearest centroid, with its distance to it.
Searching takes two passes. The first looks into the nearest cells that hold k vectors and gives each query a distance within which its k nearest lie. The second looks into the cells that may hold anything as near: a cell
of radii r to R at distance d from the query holds nothing nearer than max(d - R, r - d), nor than the plane half way between its centroid and that of the query's own cell; within a cell, vectors whose own distance
to the centroid rules them out are passed over. What is left is compared by the very arithmetic of the flat search, so results, ties included, are the same row for row. Cells that no
query needs are not read: each is a folder of the table. Vectors written after the index was built are searched flat beside it.

How much that saves depends on the vectors: well on clusters, hardly on noise of many dimensions (``visits`` tells).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import vectors as flat

#: Vectors that centroids are fitted to, cells of an index, and distances of queries to centroids that are held at once: more queries are searched in groups.
MOST_SAMPLE, MOST_CELLS, MOST_PAIRS = 20_000, 4096, 4_000_000
#: Vectors whose distances to all centroids are held at once.
ROWS = 1000
ROUNDS = 8
#: Cell of vectors that are null or of another dimension; it is never searched.
NO_CELL = -1


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def _own(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector."""
    return np.concatenate([_squared(x[i : i + ROWS], centres).argmin(1) for i in range(0, len(x), ROWS)]) if len(x) else np.zeros(0, np.int64)


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by k-means, from spread-out rows of the sample; the same for the same sample."""
    rng = np.random.default_rng(7)
    distinct = np.unique(sample, axis=0)
    cells = min(cells, len(distinct))
    centres = distinct[rng.choice(len(distinct), cells, replace=False)]
    for _ in range(rounds):
        own = _own(sample, centres)
        n = np.bincount(own, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class VectorIndex:
    """vec_id and embedding in cells under a path. metric: l2 or cosine (cells of unit vectors)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = sorted(spark.read.parquet(f"{self.path}/cells").collect(), key=lambda r: r.cell)  # MOST_CELLS at most
        self.metric = rows[0].metric if rows else "l2"
        self.cells = np.array([r.cell for r in rows], np.int64)
        self.centres = np.array([r.centre for r in rows], np.float64).reshape(len(rows), -1 if rows else 1)
        self.sizes = np.array([r.n for r in rows], np.int64)
        self.least, self.most = (np.array([r[c] for r in rows], np.float64) for c in ("least", "most"))
        self.rest: DataFrame | None = None

    @classmethod
    def build(cls, vectors: DataFrame, path: str, metric: str = "l2", cells: int | None = None, sample: int = MOST_SAMPLE) -> VectorIndex:
        """vectors: vec_id, embedding. cells: about the root of their number if not given. The dimension is that of most of the sample; vectors of another one, and nulls, are kept and never found."""
        if metric not in ("l2", "cosine"):
            raise ValueError(f"unknown metric {metric}")
        spark, v = vectors.sparkSession, vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        n, most, place = v.count(), min(sample, MOST_SAMPLE), F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
        some = v.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        if n > 4 * most:  # before the sort, of which each task sends its best
            some = some.where(place < math.ceil((1 << 40) * 2 * most / n))
        given = some.orderBy(place, "vec_id").limit(most).collect()
        sizes = [len(r.embedding) for r in given]
        dim = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 1
        rows = np.array([r.embedding for r in given if len(r.embedding) == dim], np.float64).reshape(-1, dim)
        wanted = min(MOST_CELLS, max(1, cells or int(n**0.5)))
        unit = metric == "cosine"
        centres = fit(_units(rows) if unit else rows, wanted) if len(rows) else np.zeros((0, dim))
        shared = spark.sparkContext.broadcast(centres)  # MOST_CELLS rows at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for b in batches:
                e, at = flat._matrix(b.column(1), centres.shape[1])
                cell, r = np.full(b.num_rows, NO_CELL, np.int64), np.zeros(b.num_rows)
                if len(at) and len(centres):
                    x = _units(e) if unit else e
                    own = _own(x, centres)
                    cell[at], r[at] = own, np.sqrt(((x - centres[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(r), pa.array(cell)], ["vec_id", "embedding", "radius", "cell"])

        placed = v.mapInArrow(run, "vec_id bigint, embedding array<double>, radius double, cell bigint")
        placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(1 + n // (wanted * 1_000_000)))).repartition("cell", "part").drop("part").sortWithinPartitions("cell", "radius").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
        made = spark.read.schema("vec_id bigint, embedding array<double>, radius double, cell bigint").parquet(f"{path}/vectors")
        stats = made.where(F.col("cell") >= 0).groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most"))
        places = spark.createDataFrame([(i, c.tolist(), metric) for i, c in enumerate(centres)], "cell bigint, centre array<double>, metric string")
        places.join(stats, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path)

    @property
    def group(self) -> int:
        """Queries that are searched at once."""
        return max(1, min(flat.MOST_QUERIES, MOST_PAIRS // max(1, len(self.cells))))

    def scan(self) -> DataFrame:
        """All vectors: vec_id, embedding."""
        kept = self._table().select("vec_id", "embedding")
        return kept if self.rest is None else kept.unionByName(self.rest)

    def _table(self) -> DataFrame:
        return self.spark.read.schema("vec_id bigint, embedding array<double>, radius double, cell bigint").parquet(f"{self.path}/vectors")

    def beside(self, rest: DataFrame) -> VectorIndex:
        """This index, with vectors that it does not hold, searched flat."""
        out = VectorIndex(self.spark, self.path)
        out.rest = rest.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return out

    def _distances(self, q: np.ndarray) -> np.ndarray:
        """Of queries to centroids."""
        x = _units(q) if self.metric == "cosine" else q
        return np.sqrt(_squared(x, self.centres))

    def _nearest_cells(self, d: np.ndarray, k: int) -> np.ndarray:
        """The first pass: the nearest cells of each query that hold k vectors together."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """No vector of a cell is nearer to a query than this; a little is taken off for rounding."""
        low = np.maximum(np.maximum(d - self.most, self.least - d), 0)
        if len(self.centres) > 1:
            own = d.argmin(1)
            apart = np.sqrt(_squared(self.centres[own], self.centres))
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 1e-9, (d**2 - d.min(1)[:, None] ** 2) / (2 * apart), 0)
            low = np.maximum(low, plane)
        return np.maximum(low - _slack(d), 0)

    def _look(self, ids: np.ndarray, q: np.ndarray, d: np.ndarray, wanted: np.ndarray, within: np.ndarray, k: int) -> DataFrame:
        """query_id, vec_id, distance: of each task, the best k of each query in the cells it wants, nearer than within."""
        needed = np.flatnonzero(wanted.any(0))
        schema = "query_id bigint, vec_id bigint, distance double"
        if not len(needed):
            return self.spark.createDataFrame([], schema)
        place = np.full(int(self.cells.max()) + 1, -1)
        place[self.cells] = np.arange(len(self.cells))
        shared, metric = self.spark.sparkContext.broadcast((ids, q, d, wanted, within, place)), self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, d, wanted, within, place = shared.value
            best: list[list[np.ndarray]] = []
            for b in batches:
                e, at = flat._matrix(b.column(1), q.shape[1])
                keys, radius, cell = (b.column(i).to_numpy(zero_copy_only=False)[at] for i in (0, 2, 3))
                for c in np.unique(cell):
                    rows, own = np.flatnonzero(cell == c), place[c]
                    asks = np.flatnonzero(wanted[:, own])
                    slack = _slack(d[asks, own])
                    # vectors that no query can want by their distance to the centroid are left out of the product
                    low, high = (d[asks, own] - within[asks] - slack).min(initial=np.inf), (d[asks, own] + within[asks] + slack).max(initial=-np.inf)
                    rows = rows[(radius[rows] >= low) & (radius[rows] <= high)]
                    if len(rows) and len(asks):
                        best += flat.block_best(ids[asks], q[asks], keys[rows], e[rows], k, metric)
                if sum(len(x[0]) for x in best) > 4 * k * len(ids):
                    best = [flat.best_of(best, k)]
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat.best_of(best, k)], ["query_id", "vec_id", "distance"])

        table = self._table()
        if len(needed) < len(self.cells):
            table = table.where(F.col("cell").isin([int(c) for c in self.cells[needed]]))
        return table.where(F.col("cell") >= 0).mapInArrow(run, schema)

    def _passes(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray, DataFrame]:
        from tessera.sources.tables import cut

        d = self._distances(q)
        first = self._nearest_cells(d, k)
        near = cut(self._look(ids, q, d, first, np.full(len(ids), np.inf), k))
        kept = flat.ranked(near, k).groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        far = {r.query_id: r.far for r in kept.where(F.col("n") >= k).collect()}  # a row a query of the group
        within = np.array([far.get(i, np.inf) for i in ids.tolist()])
        within = np.sqrt(np.maximum(within if self.metric == "l2" else 2 * within, 0))
        second = (self.bounds(d) <= within[:, None]) & ~first
        return near, first, second, self._look(ids, q, d, second, within, k)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, distance of the k nearest at least (some more of each task); queries: query_id, embedding, a group that the driver holds."""
        ids, q = flat.held(queries)
        if not len(ids) or not len(self.cells) or q.shape[1] != self.centres.shape[1]:
            found = self.spark.createDataFrame([], "query_id bigint, vec_id bigint, distance double")
        else:
            near, *_, more = self._passes(ids, q, k)
            found = near.unionByName(more)
        return found if self.rest is None else found.unionByName(flat.scanned(queries, self.rest, k, self.metric))

    def visits(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, cells, vectors, share: of the index, what a search of each query looks into."""

        def some(group: DataFrame) -> DataFrame:
            ids, q = flat.held(group)
            schema = "query_id bigint, cells bigint, vectors bigint, share double"
            if not len(ids) or not len(self.cells):
                return self.spark.createDataFrame([], schema)
            _, first, second, _ = self._passes(ids, q, k)
            seen, total = first | second, int(self.sizes.sum())
            rows = [(int(i), int(s.sum()), int(self.sizes[s].sum()), float(self.sizes[s].sum() / total)) for i, s in zip(ids, seen, strict=True)]
            return self.spark.createDataFrame(rows, schema)

        return flat.in_groups(queries.select("query_id", "embedding"), self.group, some)


def _slack(d: np.ndarray) -> np.ndarray:
    """More than what rounding may add to a distance or a bound."""
    return 1e-7 * (1 + d)
