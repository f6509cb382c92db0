"""Exact order statistics of groups of any size, by counting.

The place of a value is found digit by digit: the range of a group's values is cut into BUCKETS equal parts, whose rows are counted (before the shuffle, so a part is a row a task); the counts
say in which part a rank lies, and the next pass counts within that part. After the passes the values that are left are counted by value. No task holds a group's values: what it
holds of a group is at most BUCKETS counts a rank, and the distinct values in a range of ``BUCKETS ** -passes`` of the group's. Values are finite numbers; nulls do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def _same(a: list[str], b: str) -> Column:
    """Equality of the columns of both sides, nulls included."""
    out = F.lit(True)
    for c in a:
        out = out & F.col(c).eqNullSafe(F.col(f"{b}{c}"))
    return out


def order_statistics(df: DataFrame, column: str, by: list[str], positions: dict[str, Column], passes: int = 2) -> DataFrame:
    """by columns, rank_name, value: the value at each position (from 0, an expression over n, the group's count) in ascending order."""
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    named = F.array(*(F.struct(F.lit(k).alias("rank_name"), p.cast("long").alias("at")) for k, p in positions.items()))
    wanted = groups.select(*by, "lo", "hi", F.explode(named).alias("r")).select(*by, "lo", "hi", "r.rank_name", "r.at")
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS))).otherwise(F.lit(0))
    for _ in range(passes):
        # ranges are shared by ranks: each is counted once
        ranges = wanted.select(*(F.col(c).alias(f"_{c}") for c in by), "lo", "hi").distinct()
        inside = rows.join(ranges, _same(by, "_") & F.col("_v").between(F.col("lo"), F.col("hi"))) if by else rows.join(ranges, F.col("_v").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy(*by, "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min("_v").alias("lo2"), F.max("_v").alias("hi2"))
        before = Window.partitionBy(*by, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        counts = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), "lo2", "hi2", "before", "c")
        at = (_same(by, "_") if by else F.lit(True)) & (F.col("lo") == F.col("lo1")) & (F.col("hi") == F.col("hi1")) & (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("c"))
        wanted = wanted.join(counts, at).select(*by, F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "rank_name", (F.col("at") - F.col("before")).alias("at"))
    ranges = wanted.select(*(F.col(c).alias(f"_{c}") for c in by), "lo", "hi").distinct()
    inside = rows.join(ranges, (_same(by, "_") if by else F.lit(True)) & F.col("_v").between(F.col("lo"), F.col("hi")))
    values = inside.groupBy(*by, "lo", "hi", F.col("_v").alias("value")).agg(F.count("*").alias("c"))
    before = Window.partitionBy(*by, "lo", "hi").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    values = values.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), "value", "before", "c")
    at = (_same(by, "_") if by else F.lit(True)) & (F.col("lo") == F.col("lo1")) & (F.col("hi") == F.col("hi1")) & (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("c"))
    return wanted.join(values, at).select(*by, "rank_name", "value")


def percentiles(df: DataFrame, column: str, by: list[str], shares: dict[str, float], passes: int = 2) -> DataFrame:
    """by columns and a column for each share: percentiles with linear interpolation between neighbours, as Spark's percentile() gives them."""
    place = {k: (F.col("n") - 1) * F.lit(p) for k, p in shares.items()}
    found = order_statistics(df, column, by, {f"{k}:{side}": f(p) for k, p in place.items() for side, f in (("low", F.floor), ("high", F.ceil))}, passes)
    wide = found.groupBy(*by).pivot("rank_name", [f"{k}:{s}" for k in shares for s in ("low", "high")]).agg(F.first("value"))
    n = df.where(F.col(column).isNotNull()).groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("n"))
    both = wide.join(n, _same(by, "_")) if by else wide.join(n)
    mixed = []
    for k, p in place.items():
        low, high = F.col(f"`{k}:low`"), F.col(f"`{k}:high`")
        mixed.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(k))
    return both.select(*by, *mixed)
