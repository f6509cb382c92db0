import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import evaluate, selection


@pytest.mark.parametrize("passes", [0, 1, 2])
def test_percentiles_equal_sorting(spark, passes):
    rnd = random.Random(2)
    values = {"even": [float(i) for i in range(1000)], "one": [3.5], "same": [2.0] * 500, "wide": [10.0 ** rnd.uniform(-12, 12) * rnd.choice([1, -1]) for _ in range(700)], "ties": [float(rnd.randrange(4)) for _ in range(333)], None: [1.0, 2.0], "none": [None, None]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("even", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"a": 0.0, "b": 0.25, "median": 0.5, "p99": 0.99, "z": 1.0}
    want = {r.g: tuple(r.p) if r.p else None for r in df.groupBy("g").agg(F.percentile("v", F.array(*(F.lit(s) for s in shares.values()))).alias("p")).collect()}
    got = {r.g: tuple(r[k] for k in shares) for r in selection.percentiles(df, "v", ["g"], shares, passes).collect()}
    assert got == {g: p for g, p in want.items() if p}
    (all_,) = selection.percentiles(df, "v", [], shares, passes).collect()
    assert all_.median == pytest.approx(np.percentile([v for _, v in rows if v is not None], 50))


def test_no_task_holds_the_values_of_a_group(spark):
    """What is grouped by value in the last step is a small part of a group."""
    df = spark.range(200_000).selectExpr("cast(id as double) / 7 as v", "'g' as g")
    found = selection.order_statistics(df, "v", ["g"], {"mid": F.col("n") / 2})
    assert found.first().value == 100_000 / 7
    assert "percentile(" not in found._jdf.queryExecution().executedPlan().toString()


def test_latency_is_as_before(spark):
    rows = [("a", float(x)) for x in (5, 1, 9, 2)] + [("b", None), (None, 4.0)]
    got = {r.kind: r for r in evaluate.latency(spark.createDataFrame(rows, "kind string, ms double"), "ms", "kind").collect()}
    assert (got["a"].n, got["a"].median, got["a"].p95, got["a"].min, got["a"].max) == (4, 3.5, pytest.approx(8.4), 1.0, 9.0)
    assert got["b"].n == 0 and got["b"].median is None and got[None].p99 == 4.0
    (one,) = evaluate.latency(spark.createDataFrame(rows, "kind string, ms double"), "ms").collect()
    assert one.median == 4.0
