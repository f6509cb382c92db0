"""Reranking by an external score: parsing scores, and choosing what stays."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CONTENT = 1000


class TextGenerator(Protocol):
    """A model that answers prompts; tests and offline runs use a function."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def parse_score(answer: Column) -> Column:
    """First number of an answer on a scale of 0 to 10, as 0 to 1; 0.5 if there is none."""
    number = F.regexp_extract(F.coalesce(answer, F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(number == "", F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), number.cast("double"))) / 10)


def sigmoid(raw: Column) -> Column:
    return 1 / (1 + F.exp(-raw))


def rerank(results: DataFrame, score: Column, k: int = 5, threshold: float = 0.0) -> DataFrame:
    """Best k of each query by score (ties by rank) that reach the threshold. A query with k results or fewer is left in its order if there is no threshold."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    d = results.withColumn("_n", n).withColumn("rerank_score", score)
    skip = (F.col("_n") <= k) & F.lit(threshold == 0.0)
    d = d.where(skip | (F.col("rerank_score") >= threshold))
    order = Window.partitionBy("query_id").orderBy(F.when(skip, F.lit(0.0)).otherwise(-F.col("rerank_score")), "rank")
    return d.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).drop("_n")


def ask(results: DataFrame, generator: Callable[[list[str]], list[str]], template: str) -> DataFrame:
    """results (query_id, text, page_content, ...) with answer: what a generator says to the template filled with query and document, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            prompts = [template.format(query=q, document=(d or "")[:MOST_CONTENT]) for q, d in zip(pdf["text"], pdf["page_content"], strict=True)]
            yield pdf.assign(answer=pd.Series(generator(prompts), dtype=object, index=pdf.index))

    return results.mapInPandas(run, T.StructType([*results.schema.fields, T.StructField("answer", T.StringType())]))


def by_scorer(results: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k: int = 5, threshold: float = 0.0) -> DataFrame:
    """results (query_id, text, page_content, rank, ...) reranked by a scorer of (queries, the first MOST_CONTENT characters of documents). A batch whose scoring fails twice gets its scores from the order it
    is in, above any threshold."""

    def run(batches):
        for pdf in batches:
            for _ in range(2):
                try:
                    scores = list(scorer(pdf["text"].tolist(), [(d or "")[:MOST_CONTENT] for d in pdf["page_content"]]))
                    break
                except Exception:  # what a remote model raises is unknown; the order stays
                    scores = (1.0 + 1.0 / (1.0 + pdf["rank"])).tolist()
            yield pdf.assign(raw_score=pd.Series(scores, dtype=float, index=pdf.index))

    scored = results.mapInPandas(run, T.StructType([*results.schema.fields, T.StructField("raw_score", T.DoubleType())]))
    return rerank(scored, F.col("raw_score"), k, threshold)
