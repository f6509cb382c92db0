"""Mixing sources to target weights by entropy balancing.

Targets first: each source is due a share of the budget by its weight, at most ``cap`` times its own size; what that cuts off is shared
again among the rest until no target is above its cap. Then rates: document i of source s is taken at the rate

    r_i = cap / (1 + exp(-(b + lambda_s * size_i / mean_s))),   with b such that lambda_s = 0 takes each document once,

the solution of maximum (bounded) entropy under the constraint ``sum r_i size_i = target_s``. The dual is convex and separable; safeguarded Newton
iterations run as grouped aggregations over the table of (source, size, documents of that size), which gives the same sums as one row
per document at a fraction of the rows. Rates become whole copies by carrying the rounding error from the largest sizes
down, so that a source's total misses its target by half of one of its small documents as a rule; which documents of a size get the extra copy is decided by a hash of
their ids, so reruns agree.

Defined cases: null and empty texts have size 0 and are taken 0 words; a null source is a source of its own, after the others in order;
a repeated id is a document each time; an empty table gives no rows. The sources (not the documents) are held by the driver: at most MAX_SOURCES, checked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.llm.words import slices
from tessera.llm.work import Work, buckets_for, lean, small_batches

MAX_SOURCES = 100_000
#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Newton stops when every source's words are this near its target (a share of the target), or after so many rounds.
NEAR, MOST_ROUNDS = 1e-9, 60


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size (words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(2)):
                _, _, first = s.words()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.rows), b.column(1).slice(s.first, s.rows), pa.array(first[1:] - first[:-1])], ["id", "source", "size"])

    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), docs[text_col].alias("text")).mapInArrow(lean(run), f"id {docs.schema[id_col].dataType.simpleString()}, source string, size bigint")


def targets(totals: dict[str | None, int], budget: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """Words due from each source. Strings order by code point, null last."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = budget * sum(totals.values()), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in order if s in free and weight[s] * share > cap * totals[s]]
        if not full:
            return out | {s: weight[s] * share for s in free}
        for s in full:
            out[s] = cap * totals[s]
            left -= out[s]
            free.discard(s)
    return out


def _rate(tilt, size, mean, cap: float):
    """Rate under a tilt, as a Spark column."""
    x = F.lit(math.log(1 / (cap - 1)) if cap > 1 else 0.0) + tilt * size / mean
    return F.lit(cap) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), x))))


def solve(histogram: DataFrame, state: dict[int, dict], cap: float) -> dict[int, float]:
    """Tilts by number of source. histogram: s (number of the source), size, n. state: s -> total, target, mean."""
    spark = histogram.sparkSession
    tilt = {s: 0.0 for s in state}
    low, high = {s: -math.inf for s in state}, {s: math.inf for s in state}
    # a target at its bound has its tilt at infinity: all or nothing is taken
    open_ = {s for s, v in state.items() if 0 < v["target"] < cap * v["total"] * (1 - NEAR)}
    for s, v in state.items():
        if s not in open_:
            tilt[s] = math.inf if v["target"] > 0 else -math.inf
    # sums of decimals do not depend on the order in which tasks end, so reruns take the same steps
    exact = lambda x: F.sum(x.cast("decimal(28,9)")).cast("double")
    for _ in range(MOST_ROUNDS):
        if not open_:
            break
        now = spark.createDataFrame([(s, tilt[s], state[s]["mean"]) for s in open_], "s int, tilt double, mean double")
        r = _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
        sums = histogram.join(F.broadcast(now), "s").withColumn("r", r).groupBy("s").agg(exact(F.col("n") * F.col("size") * F.col("r")).alias("words"), exact(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * F.col("r") * (1 - F.col("r") / cap)).alias("slope")).collect()
        for row in sums:
            s, gap = row.s, state[row.s]["target"] - row.words
            if abs(gap) <= NEAR * state[s]["target"]:
                open_.discard(s)
                continue
            if gap > 0:
                low[s] = tilt[s]
            else:
                high[s] = tilt[s]
            step = tilt[s] + gap / row.slope if row.slope > 0 else math.nan
            if not low[s] < step < high[s]:  # Newton left the bracket: double towards the open side, else halve
                a, b = low[s], high[s]
                step = (a + b) / 2 if math.isfinite(a + b) else (max(1.0, 2 * a) if b == math.inf else min(-1.0, 2 * b))
            if step == tilt[s]:
                open_.discard(s)
            tilt[s] = step
    return tilt


def _by(*by: str, order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def mix(docs: DataFrame, budget: float = 1.5, cap: int = 2, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, rate, copies (whole) and taken (copies times size) of every document."""
    spark = docs.sparkSession
    work = Work(spark, "mixing")
    all_sizes = work.keep(sizes(docs, id_col, text_col, source_col), "sizes")
    found = all_sizes.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total = {r.source: r.total for r in found}
    target = targets(total, budget, cap, weights)
    number = {r.source: i for i, r in enumerate(sorted(found, key=lambda r: (r.source is None, r.source or "")))}
    state = {number[r.source]: {"total": r.total, "target": target[r.source], "mean": max(r.total / r.n, 1e-9)} for r in found}
    sources = spark.createDataFrame([(s, i, total[s], float(target[s])) for s, i in number.items()], "source string, s int, source_size bigint, target double")
    buckets = buckets_for(spark, sum(r.n for r in found), 100_000)
    # ties of a size are dealt over buckets by id, so that no size has all its documents in one task
    numbered = all_sizes.join(F.broadcast(sources), all_sizes.source.eqNullSafe(sources.source)).select("id", all_sizes.source, "size", "s", "source_size", "target", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"))
    counted = work.keep(numbered.groupBy("s", "size", "bucket").agg(F.count("*").alias("n")), "counted")
    histogram = work.keep(counted.groupBy("s", "size").agg(F.sum("n").alias("n")), "histogram")
    tilt = solve(histogram, state, float(cap))
    rows = [(s, state[s]["mean"], tilt[s]) for s in state]
    rates = histogram.join(F.broadcast(spark.createDataFrame(rows, "s int, mean double, tilt double")), "s").withColumn(
        "rate", F.when(F.col("tilt") == math.inf, F.lit(float(cap))).when(F.col("tilt") == -math.inf, F.lit(0.0)).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean"), float(cap)))
    )

    def round_down(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole copies of each size, largest first, each carrying what the ones before it missed. A source has a row a size."""
        pdf = pdf.sort_values("size", ascending=False)
        due, given, out = 0.0, 0, []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
            due += size * n * rate
            k = int(min(cap * n, max(0, round((due - given) / size)))) if size else int(n * rate)
            given += k * size
            out.append(k)
        return pdf.assign(k=out)[["s", "size", "n", "rate", "k"]]

    whole = rates.select("s", "size", "n", "rate").groupBy("s").applyInPandas(round_down, "s int, size bigint, n bigint, rate double, k bigint")
    before = counted.withColumnRenamed("n", "here").withColumn("before", F.sum("here").over(_by("s", "size", order="bucket")) - F.col("here"))
    plan = work.keep(before.join(whole, ["s", "size"]).select("s", "size", "bucket", "before", "n", "rate", "k"), "plan")
    ranked = numbered.withColumn("place", F.row_number().over(_by("s", "size", "bucket", order="id")))
    out = ranked.join(plan, ["s", "size", "bucket"])
    extra = (F.col("before") + F.col("place") <= F.col("k") % F.col("n")).cast("long")
    copies = F.floor(F.col("k") / F.col("n")).cast("long") + extra
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))



def repeat(docs: DataFrame, budget: float = 1.5, cap: int = 2, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it; rows that share an id are taken alike (as the most of them)."""
    copies = mix(docs, budget, cap, weights, id_col, text_col, source_col).groupBy(F.col(id_col).alias("_id")).agg(F.max("copies").cast("int").alias("_copies")).where("_copies > 0")
    taken = docs.join(copies, docs[id_col].eqNullSafe(copies["_id"]))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*(taken[c] for c in docs.columns))
