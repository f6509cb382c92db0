"""Ingestion sessions and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import cut


def sessions(sources: DataFrame) -> DataFrame:
    """sources (session_id, success, document_count, bytes, processing_time_ms, at) -> a row a session."""
    ok = F.col("success").cast("int")
    return sources.groupBy("session_id").agg(
        F.count("*").alias("n_sources"), F.sum(ok).alias("n_ok"), F.avg(ok).alias("success_rate"), F.sum("document_count").alias("documents"), F.sum("bytes").alias("bytes"),
        F.sum("processing_time_ms").alias("processing_time_ms"), F.min("at").alias("started"), F.max("at").alias("ended"), (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))).alias("duration_us"),
    )


def recent(per_session: DataFrame, n: int) -> DataFrame:
    return per_session.orderBy(F.desc("started"), "session_id").limit(n)


def rolling(sources: DataFrame, now: Column, days: int) -> DataFrame:
    """The last days, from midnight: a row a source_type, and one over all (source_type null)."""
    since = F.date_trunc("DAY", now) - F.make_dt_interval(F.lit(days))
    ok = F.col("success").cast("int")
    return sources.where((F.col("at") >= since) & (F.col("at") <= now)).rollup("source_type").agg(F.count("*").alias("n_sources"), F.sum(ok).alias("n_ok"), F.avg(ok).alias("success_rate"), F.sum("processing_time_ms").alias("processing_time_ms"))


def pages_of_sources(docs: DataFrame, page_break: str = "\n\f\n") -> DataFrame:
    """Documents (source, page, text) in the order of pages (ties by text): source, place (from 1), start (of the page in the joined document, in characters), page, text.

    Pages stay rows, so a source may be of any size. Rows are sorted by ranges of (source, page), which also split a large source; its running sums are those of its ranges
    and, within each, of its pages."""
    size = F.length(F.coalesce("text", F.lit(""))) + len(page_break)
    d = cut(docs.select("source", "page", F.coalesce("text", F.lit("")).alias("text"), size.cast("long").alias("size")).repartitionByRange("source", "page", "text").withColumn("part", F.spark_partition_id()))
    whole = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("n_before"), F.coalesce(F.sum("chars").over(whole), F.lit(0)).alias("chars_before"))
    within = Window.partitionBy("source", "part").orderBy("page", "text")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"own": F.row_number().over(within), "own_start": F.coalesce(F.sum("size").over(upto), F.lit(0))})
    d = d.join(parts, d.source.eqNullSafe(parts.s) & (d.part == parts.p))
    return d.select("source", (F.col("n_before") + F.col("own")).alias("place"), (F.col("chars_before") + F.col("own_start")).alias("start"), "page", "text")


def by_source(pages: DataFrame, page_break: str = "\n\f\n", preview: int = 320) -> DataFrame:
    """pages (as pages_of_sources gives them) -> source, n_pages, n_chars (joined), preview: its first characters, from the pages that they stand on."""
    piece = F.concat(F.when(F.col("place") == 1, F.lit("")).otherwise(F.lit(page_break)), F.substring("text", 1, preview))
    first = F.when(F.col("start") < preview + len(page_break), F.struct("place", piece.alias("piece")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["piece"]), "")
    return pages.groupBy("source").agg(F.count("*").alias("n_pages"), F.max(F.col("start") + F.length("text")).alias("n_chars"), F.substring(joined, 1, preview).alias("preview"))


def summaries(docs: DataFrame, n: int = 5, most: int = 200) -> DataFrame:
    """First n documents by id, line breaks as spaces, cut after most characters."""
    flat = F.translate("text", "\n", " ")
    cut = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)
    return docs.orderBy("doc_id").limit(n).select("doc_id", cut.alias("summary"))


def cost(texts: DataFrame, chars_per_token: float = 4.0, price_per_million: float = 0.02) -> DataFrame:
    """Tokens and price of embedding all texts, by length."""
    tokens = F.sum(F.ceil(F.length("text") / F.lit(chars_per_token)))
    return texts.agg(F.count("*").alias("n_texts"), tokens.alias("tokens"), (tokens * F.lit(price_per_million) / F.lit(1e6)).alias("price"))


