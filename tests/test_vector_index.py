import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import vectors
from tessera.operators.vector_index import VectorIndex, fit


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + i, None if x is None else [float(v) for v in x]) for i, x in enumerate(rows)], "vec_id bigint, embedding array<double>").repartition(4)


def clustered(n, dim, clusters, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "distance").collect())


@pytest.fixture(scope="module")
def many(spark):
    x = clustered(3000, 8, 30)
    x[100:140] = x[7]  # ties
    x[200:260] = 0
    return x, frame(spark, x).cache()


@pytest.mark.parametrize("metric,cells,k", [("l2", 1, 5), ("l2", 40, 8), ("l2", 300, 60), ("cosine", 40, 8), ("cosine", 200, 90), ("l2", 40, 3500)])
def test_equals_the_flat_search_row_for_row(spark, tmp_path, many, metric, cells, k):
    x, df = many
    queries = df.where("vec_id % 111 = 0 or vec_id in (7, 205)").select(F.col("vec_id").alias("query_id"), "embedding")
    index = VectorIndex.build(df, f"file://{tmp_path}/index", metric, cells)
    assert got(vectors.nearest(queries, index, k, metric)) == got(vectors.nearest(queries, df, k, metric))


def test_more_queries_than_are_held_at_once(spark, tmp_path, many, monkeypatch):
    from tessera.operators import vector_index

    _, df = many
    queries = df.where("vec_id % 200 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = VectorIndex.build(df, f"file://{tmp_path}/groups", "l2", 20)
    monkeypatch.setattr(vector_index, "MOST_PAIRS", 100)
    assert index.group == 5 and got(vectors.nearest(queries, index, 4)) == got(vectors.nearest(queries, df, 4))
    assert index.visits(queries, 4).count() == queries.count()


def test_share_that_is_looked_into_falls_with_the_cells(spark, tmp_path, many):
    _, df = many
    queries = df.where("vec_id % 50 = 0 and vec_id not between 100 and 260").select(F.col("vec_id").alias("query_id"), "embedding")
    shares = []
    for cells in (1, 10, 60):
        index = VectorIndex.build(df, f"file://{tmp_path}/{cells}", "l2", cells)
        shares.append(index.visits(queries, 5).agg(F.avg("share")).first()[0])
    assert shares[0] == 1 and shares[0] > 2 * shares[1] > 4 * shares[2]


def test_a_sample_is_enough(spark, tmp_path, many):
    """Centroids from a few vectors, which are chosen before they are sorted: coarser cells, the same rows."""
    _, df = many
    queries = df.where("vec_id % 300 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = VectorIndex.build(df, f"file://{tmp_path}/sampled", "l2", 30, sample=50)
    assert 5 < len(index.cells) <= 30 and index.sizes.sum() == 3000
    assert got(vectors.nearest(queries, index, 4)) == got(vectors.nearest(queries, df, 4))


def test_bounds_hold(spark, tmp_path, many):
    x, df = many
    index = VectorIndex.build(df, f"file://{tmp_path}/bounds", "l2", 50)
    low = index.bounds(index._distances(x[:200]))
    cell = {r.vec_id: r.cell for r in index._table().select("vec_id", "cell").collect()}
    column = {c: i for i, c in enumerate(index.cells.tolist())}
    at = np.array([column[cell[i]] for i in range(len(x))])
    true = np.sqrt(((x[:200, None] - x[None]) ** 2).sum(2))
    assert (low[:, at] <= true + 1e-9).all()


def test_only_needed_cells_are_read(spark, tmp_path, many):
    _, df = many
    index = VectorIndex.build(df, f"file://{tmp_path}/pruned", "l2", 50)
    ids, q = np.array([5]), np.array([many[0][5]])
    *_, second, more = index._passes(ids, q, 3)
    plan = more._jdf.queryExecution().executedPlan().toString()
    assert second.sum() < 25 and ("PartitionFilters: [cell" in plan or not second.any())


def test_rows_beside_an_index_and_odd_rows(spark, tmp_path):
    x = clustered(300, 4, 5)
    df = frame(spark, [*x[:200], None, [1.0], []])
    index = VectorIndex.build(df, f"file://{tmp_path}/odd", "l2", 6).beside(frame(spark, x[200:], 1000))
    everything = frame(spark, x[:200]).union(frame(spark, x[200:], 1000))
    queries = everything.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert got(vectors.nearest(queries, index, 7)) == got(vectors.nearest(queries, everything, 7))
    assert index.scan().count() == 303
    assert vectors.nearest(queries.limit(0), index, 7).count() == 0
    empty = VectorIndex.build(df.limit(0), f"file://{tmp_path}/none")
    assert vectors.nearest(queries, empty, 7).count() == 0
    other = frame(spark, [[1.0, 2.0]]).withColumnRenamed("vec_id", "query_id")
    assert vectors.nearest(other, VectorIndex(spark, index.path), 2).count() == 0
    with pytest.raises(ValueError, match="does not answer"):
        vectors.nearest(queries, index, 7, "cosine")


def test_centroids_are_the_same_for_the_same_sample():
    x = clustered(500, 3, 7)
    assert np.array_equal(fit(x, 9), fit(x.copy(), 9)) and len(fit(np.ones((4, 2)), 9)) == 1
