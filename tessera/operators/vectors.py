"""Vector search over a table of embeddings: exact top-k, thresholds, diversity, and seeds of a graph search.

Queries are rows. They are held by every task (in groups of MOST_QUERIES), vectors stream past them in Arrow blocks, and each task keeps its own
best k a query; one small window merges these. No cross join and no shuffle of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tessera.operators.vector_index import VectorIndex

MOST_QUERIES = 20_000
#: Queries of a group that are compared with a block before their best are merged.
QUERIES_AT_ONCE = 1024


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right dimension, and their places; others are dropped, as a store would."""
    lengths = np.diff(column.offsets.to_numpy())
    ok = np.flatnonzero((lengths == dim) & np.asarray(column.is_valid()))
    taken = column.take(pa.array(ok))
    return taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), ok


def in_groups(queries: DataFrame, most: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """search of all queries, in groups (by a hash of their ids) of at most about half of most where there are more than that."""
    n = queries.count()
    groups = 1 if n <= most else 2 * -(-n // most)
    parts = [search(queries if groups == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)) for g in range(groups)]
    return reduce(DataFrame.unionByName, parts)


def nearest(queries: DataFrame, vectors: DataFrame | VectorIndex, k: int, metric: str = "l2") -> DataFrame:
    """queries (query_id, embedding), vectors (vec_id, embedding, or an index of them) -> query_id, vec_id, distance, score, rank; ties by vec_id.

    l2: squared distance, score exp(-distance). cosine: 1 - cosine, score the cosine clamped to 0..1. A block is ranked by distances from a matrix product; all
    that are within its rounding error of the k-th are then compared exactly, so ties go by id. More than MOST_QUERIES queries are searched in groups. An index must be one for the metric.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    if not isinstance(vectors, DataFrame) and vectors.metric != metric:
        raise ValueError(f"an index for {vectors.metric} does not answer {metric}")
    if isinstance(vectors, DataFrame):
        most, look = MOST_QUERIES, lambda some: scanned(some, vectors, k, metric)
    else:
        most, look = vectors.group, lambda some: vectors.search(some, k)
    found = in_groups(queries.select("query_id", "embedding"), most, lambda some: ranked(look(some), k))
    score: Column = F.exp(-F.col("distance")) if metric == "l2" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance")))
    return found.withColumn("score", score)


def held(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group of queries, on the driver."""
    given = queries.collect()  # about MOST_QUERIES at most, see nearest
    return np.array([r.query_id for r in given], np.int64), np.array([r.embedding for r in given], np.float64).reshape(len(given), -1 if given else 1)


def block_best(ids: np.ndarray, q: np.ndarray, keys: np.ndarray, e: np.ndarray, k: int, metric: str) -> list[list[np.ndarray]]:
    """The best k of a block of vectors for each query: ids, keys, distances."""
    best = []
    norms = (e * e).sum(1)
    for at in range(0, len(ids), 256):
        part = q[at : at + 256]
        dots = part @ e.T
        # an upper bound of the rounding error of both forms
        error = 8 * (q.shape[1] + 8) * np.finfo(float).eps * (np.maximum(norms.max(), (part * part).sum(1)) + 1 if metric == "l2" else np.linalg.norm(part, axis=1) + 1)
        rough = norms - 2 * dots if metric == "l2" else -dots / np.maximum(np.sqrt(norms), 1e-300)
        last = min(k, e.shape[0]) - 1
        least = np.partition(rough, last, axis=1)[:, last] + error
        for i in range(len(part)):
            row = np.flatnonzero(rough[i] <= least[i])
            v, own = e[row], part[i]
            exact = ((v - own) ** 2).sum(1) if metric == "l2" else 1 - (v * own).sum(1) / np.maximum(np.linalg.norm(v, axis=1) * np.linalg.norm(own), 1e-300)
            order = np.lexsort((keys[row], exact))[:k]
            best.append([np.full(len(order), ids[at + i]), keys[row][order], exact[order]])
    return best


def best_of(found: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """The best k of each query so far, so that a task sends k rows a query however many blocks it saw."""
    ids, keys, distance = (np.concatenate([x[i] for x in found]) for i in range(3))
    order = np.lexsort((keys, distance, ids))
    ids, keys, distance = ids[order], keys[order], distance[order]
    start = np.ones(len(ids), bool)
    start[1:] = ids[1:] != ids[:-1]
    at = np.flatnonzero(start)
    kept = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids)))) < k
    return [ids[kept], keys[kept], distance[kept]]


def scanned(queries: DataFrame, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    """query_id, vec_id, distance: the best k of each task, all vectors compared."""
    shared = vectors.sparkSession.sparkContext.broadcast(held(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        if not len(ids):
            return
        best: dict[int, list[np.ndarray]] = {}
        for b in batches:
            e, rows = _matrix(b.column(1), q.shape[1])
            keys = b.column(0).to_numpy(zero_copy_only=False)[rows]
            if not len(keys):
                continue
            for at in range(0, len(ids), QUERIES_AT_ONCE):  # k rows a query are kept, as plain arrays, however many blocks and queries there are
                part = slice(at, at + QUERIES_AT_ONCE)
                found = block_best(ids[part], q[part], keys, e, k, metric)
                best[at] = best_of([best[at], *found] if at in best else found, k)
        for found in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "distance"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).mapInArrow(run, "query_id bigint, vec_id bigint, distance double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def above(results: DataFrame, least: float) -> DataFrame:
    """Threshold search: results whose score is at least `least`, ranks kept."""
    return results.where(F.col("score") >= least)


def seed_nodes(results: DataFrame, nodes: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """Nodes that share the best vectors of a query: nodes (node_id, vec_id) -> query_id, node_id, vec_id, score, at most k a query."""
    joined = results.where(F.col("score") >= min_score).join(nodes.select("node_id", "vec_id"), "vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id", "node_id"))
    return joined.withColumn("seed_rank", place).where(F.col("seed_rank") <= k).select("query_id", "node_id", "vec_id", "score", "seed_rank")


def orphans(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes without a vector in the store."""
    return nodes.join(vectors.select("vec_id"), "vec_id", "left_anti")


def mmr(queries: DataFrame, vectors: DataFrame | VectorIndex, k: int, fetch_k: int | None = None, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance (Carbonell and Goldstein 1998) over the fetch_k nearest by cosine; one query's candidates at a time."""
    fetch = fetch_k or 2 * k
    near = nearest(queries, vectors, fetch, "cosine").select("query_id", "vec_id", F.col("rank").alias("fetch_rank"), (1 - F.col("distance")).alias("relevance"))
    rows = vectors if isinstance(vectors, DataFrame) else vectors.scan()
    near = near.join(rows.select(F.col("vec_id").cast("long"), "embedding"), "vec_id")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fetch_rank").reset_index(drop=True)
        e = np.array(pdf["embedding"].tolist(), float)
        e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
        relevance, alike = pdf["relevance"].to_numpy(), e @ e.T
        chosen: list[int] = []
        while len(chosen) < min(k, len(pdf)):
            rest = [i for i in range(len(pdf)) if i not in chosen]
            worth = [weight * relevance[i] - (1 - weight) * (alike[i, chosen].max() if chosen else 0.0) for i in rest]
            chosen.append(rest[int(np.argmax(np.round(worth, 12)))])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "vec_id": pdf["vec_id"].iloc[chosen].to_numpy(), "rank": range(1, len(chosen) + 1), "relevance": relevance[chosen]})

    return near.groupBy("query_id").applyInPandas(pick, "query_id bigint, vec_id bigint, rank int, relevance double")


def search(queries: DataFrame, vectors: DataFrame | VectorIndex, k: int = 3, kind: str = "similarity", fetch_k: int | None = None, least: float = 0.5) -> DataFrame:
    """query_id, vec_id, rank, score by a named kind of search: similarity (L2), mmr, similarity_score_threshold (cosine of at least `least`); any other name is similarity."""
    if kind == "mmr":
        return mmr(queries, vectors, k, fetch_k).withColumnRenamed("relevance", "score").select("query_id", "vec_id", "rank", "score")
    if kind == "similarity_score_threshold":
        return above(nearest(queries, vectors, k, "cosine"), least).select("query_id", "vec_id", "rank", "score")
    return nearest(queries, vectors, k).select("query_id", "vec_id", "rank", "score")


def stats(vectors: DataFrame) -> DataFrame:
    """Vectors, those without an embedding, and how many dimensions there are (one row a dimension, null for none)."""
    return vectors.groupBy(F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim")).agg(F.count("*").alias("n_vectors"))
