"""Question-answering datasets as tables: questions with their evidence, and the corpus of their contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "question string, answer string, type string, supporting_facts array<array<string>>, context array<string>"
# The types of questions that need several documents.
MULTIHOP = ("comparison", "bridge", "bridge_comparison", "compositional", "inference")


def read(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """One row a question in the order of the file (a JSON list of objects): query_id, question, answer, type, supporting_facts, context; the first n if asked for.

    A context is [title, [sentences]] as published, or an object with title and sentences; types are in lower case, "unknown" where there is none."""
    df = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("query_id", F.monotonically_increasing_id())
    pair = lambda c: F.from_json(c, "array<string>")
    listed = lambda c: F.struct(pair(c)[0].alias("title"), F.from_json(pair(c)[1], "array<string>").alias("sentences"))
    one = lambda c: F.when(F.startswith(c, F.lit("[")), listed(c)).otherwise(F.from_json(c, "title string, sentences array<string>"))
    kind = F.lower(F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")))
    df = df.withColumns({"context": F.transform("context", one), "type": kind})
    return df.orderBy("query_id").limit(first) if first is not None else df


def truth(questions: DataFrame) -> DataFrame:
    """query_id, id: titles of the evidence of each question, each once."""
    return questions.select("query_id", F.explode("supporting_facts").alias("fact")).select("query_id", F.col("fact")[0].alias("id")).distinct()


def corpus(questions: DataFrame) -> DataFrame:
    """doc_id, title, text: each context once by its text, with the first title it has."""
    c = questions.select("query_id", F.posexplode("context").alias("pos", "c")).select("query_id", "pos", F.col("c.title").alias("title"), F.array_join("c.sentences", "\n").alias("text"))
    once = Window.partitionBy(F.md5("text")).orderBy("query_id", "pos")
    return c.withColumn("_n", F.row_number().over(once)).where("_n = 1").select(F.xxhash64("text").alias("doc_id"), "title", "text")


def multihop(questions: DataFrame) -> DataFrame:
    return questions.where(F.lower("type").isin(*MULTIHOP))
