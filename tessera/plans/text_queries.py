"""Registered queries over texts: chunking, extraction, parsers, sources, evaluation and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import term_overlap
from tessera.operators import chunking, evaluate, extraction, metrics, rerank
from tessera.plans.vector_queries import _L2, _near
from tessera.sources import registry, stores
from tessera.sources.tables import table
from tessera.streaming import ingest


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def chunk_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.sliding(_docs(spark, folder)).select("doc_id", "chunk_index", F.length("page_content").cast("long").alias("n_chars"), F.md5("page_content").alias("content_md5"))


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.sliding(_docs(spark, folder), 500, 50).select("doc_id", "chunk_index", "chunk_id")


def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    s = chunking.stats(chunking.sliding(_docs(spark, folder)))
    return s.select("n_chunks", "n_docs", "n_chars", F.round("mean_chars", 6).alias("mean_chars"), F.round("chunks_per_doc", 6).alias("chunks_per_doc"))


def _chunked(kind: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return chunking.chunk(_docs(spark, folder), chunking.Options(kind)).select("doc_id", "chunk_index", "chunk_id", F.length("page_content").cast("long").alias("n_chars"))

    run.__name__ = f"chunk_{kind}"
    return run


def mentions_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.mentions(_docs(spark, folder)).select("doc_id", F.col("mention_index").cast("long").alias("mention_index"), "name")


def entity_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.entities(extraction.mentions(_docs(spark, folder))).select("node_id", "key", "name", "n_mentions", "n_docs")


def entity_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.cooccurrence(extraction.mentions(_docs(spark, folder)))


def entity_links(spark: SparkSession, folder: str) -> DataFrame:
    found = extraction.mentions(_docs(spark, folder))
    known = extraction.entities(found).where("n_docs > 1")
    return extraction.link_entities(found, known).agg(F.count("*").alias("n_mentions"), F.count("node_id").alias("n_linked"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """id, text: each document as a generator might state it: JSON in a fence, a Markdown table, parts between pipes or semicolons, an arrow, or nothing that can be read."""
    doc, source = F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.coalesce("source", F.lit("nowhere"))
    forms = [
        F.concat(F.lit('Here it is:\n```json\n[{"subject": "'), doc, F.lit('", "relationship": "comes from", "object": "'), source, F.lit('"}]\n```')),
        F.concat(F.lit("| Subject | Relationship | Object |\n|---|---|---|\n| "), doc, F.lit(" | comes from | "), source, F.lit(" |")),
        F.concat(F.lit("- "), doc, F.lit(" | comes from | "), source, F.lit("\nand nothing else")),
        F.concat(F.lit("1. "), doc, F.lit("; comes from; "), source),
        F.concat(F.lit("* "), doc, F.lit(" - comes from -> "), source),
        F.lit("no relations at all"),
    ]
    form = F.coalesce(*(F.when(F.col("doc_id") % len(forms) == i, f) for i, f in enumerate(forms)))
    return _docs(spark, folder).select(F.col("doc_id").alias("id"), form.alias("text"))


def rel_parse(spark: SparkSession, folder: str) -> DataFrame:
    a = _answers(spark, folder)
    return a.select("id", F.posexplode(extraction.parse_relations(F.col("text"))).alias("pos", "t")).select("id", "pos", "t.subject", "t.relationship", "t.object")


def rel_parse_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a row of a table written by a generator, and read back."""
    d = _docs(spark, folder).select("doc_id", F.concat(F.lit("| Subject | Relationship | Object |\n|---|---|---|\n| doc "), F.col("doc_id").cast("string"), F.lit(" | comes from | "), "source", F.lit(" |\n| doc "), F.col("doc_id").cast("string"), F.lit(" | written in | "), "lang", F.lit(" |")).alias("text"))
    return d.select("doc_id", F.explode(extraction.parse_table(F.col("text"))).alias("t")).select("doc_id", "t.subject", "t.relationship", "t.object")


def rel_parse_arrow(spark: SparkSession, folder: str) -> DataFrame:
    d = _docs(spark, folder).select("doc_id", F.concat(F.lit("* doc "), F.col("doc_id").cast("string"), F.lit(" -comes from-> "), "source").alias("text"))
    return d.select("doc_id", F.explode(extraction.parse_arrow(F.col("text"))).alias("t")).select("doc_id", "t.subject", "t.relationship", "t.object")


def score_extract(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    return e.select("event_id", F.round(rerank.parse_score(F.concat(F.lit("Relevance: "), F.floor(F.col("value")).cast("string"), F.lit(".5 out of 10"))), 6).alias("score"))


def suggestion_dedup(spark: SparkSession, folder: str) -> DataFrame:
    terms = F.regexp_replace(F.lower("text"), "[^a-z\n]+", "\n")
    return _docs(spark, folder).select("doc_id", F.array_join(extraction.parse_terms(terms, 5), ",").alias("terms"))


def term_overlap_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.round(term_overlap(F.lit("the and of est la der"), F.col("text")), 6).alias("overlap"))


def source_classification(spark: SparkSession, folder: str) -> DataFrame:
    extension, is_file = registry.classify(F.col("url"))
    return table(spark, folder, "pages").select("page_id", extension.alias("extension"), is_file.alias("is_file"))


def html_text_length(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.length(registry.html_to_text("html")).cast("long").alias("n_chars"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.pages_of_sources(_docs(spark, folder).select("source", F.col("doc_id").alias("page"), "text"))


def doc_by_source_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Where each page stands in the joined document of its source."""
    return _pages(spark, folder).select("source", "page", "place", "start", F.md5("text").alias("text_md5"))


def doc_by_source_preview(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.by_source(_pages(spark, folder)).select("source", "n_pages", "n_chars", F.md5("preview").alias("preview_md5"))


def doc_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.summaries(_docs(spark, folder))


def embedding_cost(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.cost(_docs(spark, folder)).select("n_texts", "tokens", F.round("price", 9).alias("price"))


def hash_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    d = _docs(spark, folder).select("doc_id", F.col("text").alias("page_content"))
    return stores.embed(d).select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"), "error")


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Truth: vectors with the query's label, without the query."""
    e = table(spark, folder, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("class"))
    items = e.select(F.col("vec_id").alias("id"), F.col("label").alias("class"))
    return evaluate.per_query_of_classes(_near(spark, folder, 9).select("query_id", F.col("vec_id").alias("id"), "rank"), q, items, 9)


def recall_mrr_perfect(spark: SparkSession, folder: str) -> DataFrame:
    s = _scores(spark, folder).withColumn("even", F.col("query_id") % 2 == 0)
    return evaluate.summary(s, "even").select("even", "n", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "perfect_rate")))


def recall_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.recall_histogram(_scores(spark, folder))


def recall_lowest(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.lowest(_scores(spark, folder)).select("query_id", F.round("recall", 6).alias("recall"))


def latency_stats(spark: SparkSession, folder: str) -> DataFrame:
    s = evaluate.latency(_events(spark, folder), "value", "event_type")
    return s.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "p99", "min", "max", "std", "per_second")))


def relative_improvement(spark: SparkSession, folder: str) -> DataFrame:
    s = _events(spark, folder).groupBy(F.col("event_type").alias("name")).agg(F.avg((F.col("value") > 50).cast("int")).alias("perfect_rate"), F.avg("value").alias("latency"))
    return evaluate.relative(s, "click").select("name", "rate_gain", "latency_overhead")


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    return e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("source_type"), (F.col("value") > 20).alias("success"), F.floor("value").cast("long").alias("document_count"), (F.floor("value") * 100).cast("long").alias("bytes"), F.floor(F.col("value") * 10).cast("long").alias("processing_time_ms"), F.col("ts").alias("at"))


def session_metrics(spark: SparkSession, folder: str) -> DataFrame:
    s = metrics.sessions(_sources(spark, folder))
    return s.select("session_id", "n_sources", "n_ok", F.round("success_rate", 6).alias("success_rate"), "documents", "bytes", "processing_time_ms", "duration_us")


def recent_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.recent(metrics.sessions(_sources(spark, folder)), 10).select("session_id", "n_sources", F.unix_micros("started").alias("started_us"))


def rolling_by_source_type(spark: SparkSession, folder: str) -> DataFrame:
    r = metrics.rolling(_sources(spark, folder), F.lit("2024-01-20 12:00:00").cast("timestamp"), 7)
    return r.select("source_type", "n_sources", "n_ok", F.round("success_rate", 6).alias("success_rate"), "processing_time_ms")


def cache_ttl_valid(spark: SparkSession, folder: str) -> DataFrame:
    c = _events(spark, folder).select(F.col("event_type").alias("source_type"), F.col("user_id").cast("string").alias("identifier"), F.col("ts").alias("cached_at"), F.col("event_id").alias("entry_id"))
    return stores.cache_valid(c, F.lit("2024-01-20 12:00:00").cast("timestamp"), 86400 * 5).select("cache_key", "entry_id")


def windowed_event_metrics(spark: SparkSession, folder: str) -> DataFrame:
    w = ingest.windowed_metrics(_events(spark, folder))
    return w.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


_SLIDE = """SELECT doc_id, i AS chunk_index, substr(text, CAST(i * {step} + 1 AS INT), {size}) AS page_content
    FROM documents, LATERAL (SELECT unnest(range(0, CAST(greatest(1, ceil((length(text) - {overlap}) / CAST({step} AS DOUBLE))) AS BIGINT))) AS i) WHERE length(text) > 0"""
_SLIDE_1000 = _SLIDE.format(step=800, size=1000, overlap=200)
_MENTIONS = "m AS (SELECT doc_id, i - 1 AS mention_index, l[i] AS name FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+') AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"
_KEY = "lower(trim(regexp_replace(name, '[ \\t\\n]+', ' ', 'g')))"
_SCORES = f"""WITH {_L2}, truth AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
    hits AS (SELECT t.query_id, count(*) AS found, min(rank) AS first FROM truth t JOIN l2 ON l2.query_id = t.query_id AND l2.vec_id = t.id WHERE rank <= 9 GROUP BY 1),
    n AS (SELECT query_id, count(*) AS n_truth FROM truth GROUP BY 1),
    scores AS (SELECT query_id, coalesce(found, 0) / CAST(n_truth AS DOUBLE) AS recall, coalesce(1 / CAST(first AS DOUBLE), 0) AS rr, CAST(coalesce(found, 0) = n_truth AS INT) AS perfect FROM n LEFT JOIN hits USING (query_id))"""
_SOURCES = "s AS (SELECT user_id AS session_id, event_type AS source_type, value > 20 AS success, CAST(floor(value) AS BIGINT) AS document_count, CAST(floor(value) * 100 AS BIGINT) AS bytes, CAST(floor(value * 10) AS BIGINT) AS processing_time_ms, ts FROM events)"
_TERMS = "list_distinct(list_filter(string_split_regex({}, '[ \\t\\n]+'), lambda x: x <> ''))"

ORACLES = {
    "rel_parse": "SELECT doc_id AS id, 0 AS pos, 'doc ' || doc_id AS subject, 'comes from' AS relationship, coalesce(source, 'nowhere') AS object FROM documents WHERE doc_id % 6 <> 5",
    "chunk_sliding": f"SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(length(page_content) AS BIGINT) AS n_chars, md5(page_content) AS content_md5 FROM ({_SLIDE_1000})",
    "chunk_ids": f"SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) || '_' || chunk_index || '_v1' AS chunk_id FROM ({_SLIDE.format(step=450, size=500, overlap=50)})",
    "chunk_stats": f"SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, CAST(sum(length(page_content)) AS BIGINT) AS n_chars, round(avg(length(page_content)), 6) AS mean_chars, round(count(*) / CAST(count(DISTINCT doc_id) AS DOUBLE), 6) AS chunks_per_doc FROM ({_SLIDE_1000})",
    "mentions_extract": f"WITH {_MENTIONS} SELECT doc_id, mention_index, name FROM m",
    "entity_nodes": f"WITH {_MENTIONS} SELECT md5({_KEY}) AS node_id, {_KEY} AS key, min(name) AS name, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY {_KEY}",
    "entity_cooccurrence": f"WITH {_MENTIONS}, k AS (SELECT doc_id, mention_index, {_KEY} AS key FROM m) SELECT least(a.key, b.key) AS src, greatest(a.key, b.key) AS dst, count(*) AS weight FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.mention_index = a.mention_index + 1 WHERE a.key <> b.key GROUP BY ALL",
    "entity_links": f"WITH {_MENTIONS}, k AS (SELECT *, {_KEY} AS key FROM m), e AS (SELECT key FROM k GROUP BY key HAVING count(DISTINCT doc_id) > 1) SELECT count(*) AS n_mentions, count(e.key) AS n_linked FROM k LEFT JOIN e ON e.key = k.key",
    "rel_parse_table": "SELECT doc_id, 'doc ' || doc_id AS subject, 'comes from' AS relationship, source AS object FROM documents UNION ALL SELECT doc_id, 'doc ' || doc_id, 'written in', lang FROM documents",
    "rel_parse_arrow": "SELECT doc_id, 'doc ' || doc_id AS subject, 'comes from' AS relationship, source AS object FROM documents",
    "score_extract": "SELECT event_id, round(greatest(0, least(10, CAST(regexp_extract('Relevance: ' || CAST(floor(value) AS BIGINT) || '.5 out of 10', '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE))) / 10, 6) AS score FROM events",
    "suggestion_dedup": """WITH w AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^a-z\\n]+', chr(10), 'g'), chr(10))) AS t, generate_subscripts(string_split(regexp_replace(lower(text), '[^a-z\\n]+', chr(10), 'g'), chr(10)), 1) AS i FROM documents),
        f AS (SELECT doc_id, t, min(i) AS i FROM w WHERE t <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
        SELECT d.doc_id, coalesce(string_agg(t, ',' ORDER BY n), '') AS terms FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND n <= 5 GROUP BY d.doc_id""",
    "term_overlap_scores": f"SELECT doc_id, round(len(list_intersect({_TERMS.format(chr(39) + 'the and of est la der' + chr(39))}, {_TERMS.format('lower(text)')})) / CAST(6 AS DOUBLE), 6) AS overlap FROM documents",
    "source_classification": """WITH p AS (SELECT page_id, url, regexp_matches(url, '^https?://') AS web, lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '[^/.](\\.[A-Za-z0-9]+)$', 1)) AS suffix FROM pages)
        SELECT page_id, CASE WHEN web AND contains(url, 'arxiv.org') THEN 'arxiv' WHEN web AND suffix = '' THEN 'website' ELSE suffix END AS extension, NOT web AS is_file FROM p""",
    "doc_by_source_concat": "SELECT source, doc_id AS page, row_number() OVER w AS place, CAST(coalesce(sum(length(coalesce(text, '')) + 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, md5(coalesce(text, '')) AS text_md5 FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id, text)",
    "doc_by_source_preview": "WITH c AS (SELECT source, count(*) AS n_pages, string_agg(coalesce(text, ''), chr(10) || chr(12) || chr(10) ORDER BY doc_id, text) AS content FROM documents GROUP BY source) SELECT source, n_pages, CAST(length(content) AS BIGINT) AS n_chars, md5(substr(content, 1, 320)) AS preview_md5 FROM c",
    "doc_summaries": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(replace(text, chr(10), ' '), 1, 200) || '...' ELSE replace(text, chr(10), ' ') END AS summary FROM documents ORDER BY doc_id LIMIT 5",
    "embedding_cost": "SELECT count(*) AS n_texts, CAST(sum(ceil(length(text) / CAST(4 AS DOUBLE))) AS BIGINT) AS tokens, round(sum(ceil(length(text) / CAST(4 AS DOUBLE))) * CAST(0.02 AS DOUBLE) / 1000000, 9) AS price FROM documents",
    "recall_mrr_perfect": f"{_SCORES} SELECT query_id % 2 = 0 AS even, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(perfect), 6) AS perfect_rate FROM scores GROUP BY GROUPING SETS ((), (query_id % 2 = 0))",
    "recall_histogram": f"{_SCORES} SELECT round(recall, 2) AS recall, count(*) AS n FROM scores GROUP BY 1",
    "recall_lowest": f"{_SCORES} SELECT query_id, round(recall, 6) AS recall FROM scores ORDER BY scores.recall, query_id LIMIT 5",
    "latency_stats": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS std, round(count(value) / (sum(value) / 1000), 6) AS per_second FROM events GROUP BY event_type",
    "relative_improvement": """WITH s AS (SELECT event_type AS name, avg(CAST(value > 50 AS INT)) AS r, avg(value) AS l FROM events GROUP BY 1), b AS (SELECT r AS br, l AS bl FROM s WHERE name = 'click')
        SELECT name, round(100 * (r - br) / nullif(br, 0), 1) AS rate_gain, round(100 * (l - bl) / nullif(bl, 0), 1) AS latency_overhead FROM s, b""",
    "session_metrics": f"WITH {_SOURCES} SELECT session_id, count(*) AS n_sources, sum(CAST(success AS BIGINT)) AS n_ok, round(avg(CAST(success AS INT)), 6) AS success_rate, sum(document_count) AS documents, sum(bytes) AS bytes, sum(processing_time_ms) AS processing_time_ms, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM s GROUP BY session_id",
    "recent_sessions": f"WITH {_SOURCES} SELECT session_id, count(*) AS n_sources, epoch_us(min(ts)) AS started_us FROM s GROUP BY session_id ORDER BY started_us DESC, session_id LIMIT 10",
    "rolling_by_source_type": f"WITH {_SOURCES} SELECT source_type, count(*) AS n_sources, sum(CAST(success AS BIGINT)) AS n_ok, round(avg(CAST(success AS INT)), 6) AS success_rate, sum(processing_time_ms) AS processing_time_ms FROM s WHERE ts >= TIMESTAMP '2024-01-13 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY GROUPING SETS ((), (source_type))",
    "cache_ttl_valid": """WITH c AS (SELECT md5(event_type || ':' || user_id) AS cache_key, event_id AS entry_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'),
        r AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, entry_id) AS n FROM c) SELECT cache_key, entry_id FROM r WHERE n = 1""",
    "windowed_event_metrics": "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
QUERIES = {
    f.__name__: f
    for f in (
        chunk_sliding, chunk_ids, chunk_stats, *map(_chunked, ("recursive", "character", "markdown", "python", "code", "token", "header")), mentions_extract, entity_nodes, entity_cooccurrence, entity_links, rel_parse, rel_parse_table, rel_parse_arrow,
        score_extract, suggestion_dedup, term_overlap_scores, source_classification, html_text_length, doc_by_source_concat, doc_by_source_preview, doc_summaries, embedding_cost, hash_embeddings, recall_mrr_perfect, recall_histogram, recall_lowest, latency_stats,
        relative_improvement, session_metrics, recent_sessions, rolling_by_source_type, cache_ttl_valid, windowed_event_metrics,
    )
}
