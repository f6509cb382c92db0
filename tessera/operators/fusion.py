"""Combining result lists of several retrievers. Results: query_id, rank, id, page_content, score, hop_distance; order is always explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("concat", "rerank", "weighted", "expand")


def _tagged(vector: DataFrame, graph: DataFrame) -> DataFrame:
    columns = lambda d, source, n: d.select("query_id", "id", "page_content", F.col("rank").alias("own_rank"), *(F.col(c) if c in d.columns else F.lit(None).cast("double").alias(c) for c in ("hop_distance", "relevance_score")), F.lit(source).alias("retrieval_source"), F.lit(n).alias("source_order"))
    return columns(vector, "vector", 0).unionByName(columns(graph, "graph", 1))


def _ranked(d: DataFrame, *order) -> DataFrame:
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def combine(vector: DataFrame, graph: DataFrame, mode: str = "concat", vector_weight: float = 0.6, graph_weight: float = 0.4, strict: bool = False) -> DataFrame:
    """concat: vector results first. rerank: by 0.8 (1 - place / n) and 0.6 * 0.7 ** hop * relevance. weighted: prefixes of both in proportion, interleaved.
    expand: vector results as core, graph results as context; strict keeps only graph results whose query has a core."""
    d = _tagged(vector, graph)
    if mode == "concat":
        return _ranked(d.withColumn("score", F.lit(None).cast("double")), "source_order", "own_rank")
    if mode == "rerank":
        n = F.count("*").over(Window.partitionBy("query_id", "source_order"))
        vector_score = 0.8 * (1 - (F.col("own_rank") - 1) / F.greatest(n, F.lit(1)))
        graph_score = 0.6 * F.pow(F.lit(0.7), F.coalesce("hop_distance", F.lit(2.0))) * F.coalesce("relevance_score", F.lit(0.5))
        scored = d.withColumn("score", F.round(F.when(F.col("source_order") == 0, vector_score).otherwise(graph_score), 12))
        return _ranked(scored, F.desc("score"), "source_order", "own_rank")
    if mode == "weighted":
        total = vector_weight + graph_weight
        wv, wg = (vector_weight / total, graph_weight / total) if abs(total - 1) > 0.01 else (vector_weight, graph_weight)
        n = F.count("*").over(Window.partitionBy("query_id"))
        due = F.floor(F.round(n * F.when(F.col("source_order") == 0, F.lit(wv)).otherwise(F.lit(wg)), 9))
        kept = d.withColumn("due", due).where(F.col("own_rank") <= F.col("due")).drop("due")
        return _ranked(kept.withColumn("score", F.lit(None).cast("double")), "own_rank", "source_order")
    if mode == "expand":
        d = d.withColumn("role", F.when(F.col("source_order") == 0, "core").otherwise("context")).withColumn("score", F.lit(None).cast("double"))
        if strict:
            d = d.join(vector.select("query_id").distinct(), "query_id", "left_semi")
        return _ranked(d, "source_order", "own_rank")
    raise ValueError(f"unknown mode {mode}; one of {MODES}")


def first_of_content(results: DataFrame) -> DataFrame:
    """The first result of each content a query, ranks closed up."""
    once = Window.partitionBy("query_id", F.md5("page_content")).orderBy("rank")
    kept = results.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def format_context(results: DataFrame, most_chars: int | None = None, ellipsis: str = "...") -> DataFrame:
    """query_id, context: "[rank] content" blocks joined by blank lines; the block that passes most_chars is cut there, and no other follows."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("page_content"))
    d = results.select("query_id", "rank", block.alias("block"))
    if most_chars is not None:
        upto = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        d = d.withColumn("room", F.lit(most_chars) - (upto - F.length("block")))
        d = d.where("room > 0").withColumn("block", F.when(F.length("block") > F.col("room"), F.concat(F.col("block").substr(F.lit(1), F.col("room").cast("int")), F.lit(ellipsis))).otherwise(F.col("block")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return d.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def build_prompt(results: DataFrame) -> DataFrame:
    """query_id, prompt: "Document i (source: s):" and the content, for a text generator."""
    block = F.concat(F.lit("Document "), F.col("rank").cast("string"), F.lit(" (source: "), F.coalesce("source", F.lit("unknown")), F.lit("):\n"), F.col("page_content"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("prompt"))
