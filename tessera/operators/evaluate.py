"""Quality and latency of retrieval runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import selection


def latency(times: DataFrame, column: str, *by: str, accuracy: int | None = None) -> DataFrame:
    """Mean, median, percentiles (linear interpolation), extremes, population deviation, and throughput a second of milliseconds.

    Exact percentiles are found by counting, so no task holds a group's values; with an accuracy, percentiles are values of the group within 1 / accuracy of the rank, in a sketch of that size."""
    v, shares = F.col(column), {"median": 0.5, "p95": 0.95, "p99": 0.99}
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.sum(v).alias("total")]
    if accuracy:
        sketch = F.percentile_approx(v, list(shares.values()), accuracy)
        out = times.groupBy(*by).agg(*aggs, sketch.alias("p")).select("*", *(F.col("p")[i].alias(k) for i, k in enumerate(shares)))
    else:
        exact = selection.percentiles(times, column, list(by), shares).withColumnsRenamed({c: f"_{c}" for c in by})
        own = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.lit(True))
        out = times.groupBy(*by).agg(*aggs).join(exact, own, "left")
    rate = F.when(F.col("total") > 0, F.col("n") / (F.col("total") / 1000)).otherwise(F.lit(0.0))
    return out.select(*by, "n", "mean", *shares, "min", "max", "std", rate.alias("per_second"))


def per_query(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, n_truth, found, recall, reciprocal_rank, perfect for each query of truth (query_id, id); a query without truth is perfect and has no recall."""
    top = results.where(F.col("rank") <= k).select("query_id", "id", "rank")
    hits = top.join(truth.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.countDistinct("id").alias("found"), F.min("rank").alias("first"))
    n = truth.groupBy("query_id").agg(F.countDistinct("id").alias("n_truth"))
    return _rates(n, hits)


def per_query_of_classes(results: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """per_query where the truth of a query is all items of its class but itself: queries (query_id, class), items (id, class), one class each. The truth is counted by class and never listed, as its
    pairs grow with the square of a class; a query that is alone in its class has no row."""
    items, queries = items.select("id", "class").where("class IS NOT NULL").distinct(), queries.select("query_id", "class").distinct()
    sizes = items.groupBy("class").agg(F.count("*").alias("size"))
    itself = queries.join(items, (F.col("query_id") == F.col("id")) & (queries["class"] == items["class"]), "left_semi").select("query_id", F.lit(1).alias("own"))
    n = queries.join(sizes, "class").join(itself, "query_id", "left").select("query_id", (F.col("size") - F.coalesce("own", F.lit(0))).alias("n_truth")).where("n_truth > 0")
    top = results.where((F.col("rank") <= k) & (F.col("id") != F.col("query_id"))).select("query_id", "id", "rank")
    hits = top.join(queries, "query_id").join(items, ["id", "class"]).groupBy("query_id").agg(F.countDistinct("id").alias("found"), F.min("rank").alias("first"))
    return _rates(n, hits)


def _rates(n: DataFrame, hits: DataFrame) -> DataFrame:
    d = n.join(hits, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    recall = F.when(F.col("n_truth") > 0, F.col("found") / F.col("n_truth"))
    return d.select("query_id", "n_truth", "found", recall.alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("found") == F.col("n_truth")).alias("perfect"))


def summary(scores: DataFrame, group: str | None = None) -> DataFrame:
    """Averages over all queries and, if a column is given, over each of its values besides."""
    aggs = [F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("mrr"), F.avg(F.col("perfect").cast("int")).alias("perfect_rate")]
    return scores.rollup(group).agg(*aggs) if group else scores.agg(*aggs)


def recall_histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.round("recall", 2).alias("recall")).agg(F.count("*").alias("n"))


def lowest(scores: DataFrame, n: int = 5) -> DataFrame:
    return scores.orderBy("recall", "query_id").limit(n)


def relative(summaries: DataFrame, baseline: str) -> DataFrame:
    """summaries (name, perfect_rate, latency) with gains over the baseline row, in percent."""
    base = summaries.where(F.col("name") == baseline).select(F.col("perfect_rate").alias("base_rate"), F.col("latency").alias("base_latency")).limit(1)
    pct = lambda a, b: F.round(100 * (F.col(a) - F.col(b)) / F.nullif(F.col(b), F.lit(0.0)), 1)
    return summaries.join(F.broadcast(base)).select("name", "perfect_rate", "latency", pct("perfect_rate", "base_rate").alias("rate_gain"), pct("latency", "base_latency").alias("latency_overhead"))


def duplicates(results: DataFrame) -> DataFrame:
    """Results that a query lists more than once."""
    return results.groupBy("query_id", "id").agg(F.count("*").alias("n")).where("n > 1")


