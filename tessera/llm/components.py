"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.work import Work

MOST_ROUNDS = 60
#: Links of a file that a round writes: small tables are not spread over many tasks.
FILE_LINKS = 500_000


def connected_components(links: DataFrame, work: Work) -> DataFrame:
    """links: u, v (either way round, repeats allowed) -> node, label: the smallest node of its component, for every node but the smallest itself.

    Each step replaces a link by one to the least neighbour, found by a pre-aggregated minimum, so a node with a third of
    all links costs no task more than its partial minima; the table of links never grows. Each round is written to the shared folder.
    """

    def signature(t: DataFrame):
        return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = work.keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = signature(now)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = work.keep(small.coalesce(1 + seen[0] // FILE_LINKS), "links")  # links never grow in number
        was, seen = seen, signature(after)
        work.drop(now)
        now = after
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
