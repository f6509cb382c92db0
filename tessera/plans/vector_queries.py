"""Registered vector searches. Queries are the vectors whose id is divisible by 50 (a stated query set that grows with the table), searched against the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fusion, rerank, vectors
from tessera.operators.vector_index import VectorIndex
from tessera.plans import graphs
from tessera.sources.tables import folder_of, table

K = 8


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding")


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _near(spark: SparkSession, folder: str, k: int = K, metric: str = "l2") -> DataFrame:
    return vectors.nearest(_queries(spark, folder), _vectors(spark, folder), k, metric)


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.seed_nodes(_near(spark, folder, 10), graphs.nodes(spark, folder).where("vec_id IS NOT NULL"), 5, 0.0)


_built: dict[tuple[str, str, str], VectorIndex] = {}


def _index(spark: SparkSession, folder: str, metric: str = "l2") -> VectorIndex:
    """An index of all vectors, built once a session and folder."""
    key = (spark.sparkContext.applicationId, folder, metric)
    if key not in _built:
        _built[key] = VectorIndex.build(_vectors(spark, folder), folder_of(spark, "vectors"), metric)
    return _built[key]


def knn_l2_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "source", "text")
    found = _near(spark, folder).join(docs, "vec_id", "left")
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "source", F.length("text").cast("long").alias("n_chars"))


def knn_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder, K, "cosine").select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def knn_indexed_l2(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.nearest(_queries(spark, folder), _index(spark, folder), K)
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def knn_indexed_cosine(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.nearest(_queries(spark, folder), _index(spark, folder, "cosine"), K, "cosine")
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def mmr_indexed(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.mmr(_queries(spark, folder), _index(spark, folder, "cosine"), 5).select("query_id", "vec_id", "rank", F.round("relevance", 6).alias("relevance"))


def seed_nodes_indexed(spark: SparkSession, folder: str) -> DataFrame:
    near = vectors.nearest(_queries(spark, folder), _index(spark, folder), 10)
    found = vectors.seed_nodes(near, graphs.nodes(spark, folder).where("vec_id IS NOT NULL"), 5, 0.0)
    return found.select("query_id", "node_id", "vec_id", F.round("score", 6).alias("score"), "seed_rank")


def knn_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.above(_near(spark, folder, K, "cosine"), 0.5).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def mmr_topk(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.mmr(_queries(spark, folder), _vectors(spark, folder), 5).select("query_id", "vec_id", "rank", F.round("relevance", 6).alias("relevance"))


def seed_embedding_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _seeds(spark, folder).select("query_id", "node_id", "vec_id", F.round("score", 6).alias("score"), "seed_rank")


def orphan_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.orphans(graphs.nodes(spark, folder), _vectors(spark, folder)).groupBy("type").agg(F.count("*").alias("n"))


def _lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A vector list (5 nearest by L2) and a graph list (6 nearest by cosine, hops by rank) of each query, with document texts."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("page_content"))
    text = F.coalesce("page_content", F.lit(""))
    v = _near(spark, folder, 5).join(docs, "vec_id", "left").select("query_id", F.col("vec_id").alias("id"), "rank", text.alias("page_content"))
    g = _near(spark, folder, 6, "cosine").join(docs, "vec_id", "left").select("query_id", F.col("vec_id").alias("id"), "rank", text.alias("page_content"), (F.col("rank") % 3).cast("double").alias("hop_distance"), F.round("score", 6).alias("relevance_score"))
    return v, g


def _shown(d: DataFrame) -> DataFrame:
    return d.select("query_id", "id", "rank", "retrieval_source", F.round("score", 6).alias("score"))


def hybrid_concat(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(fusion.combine(*_lists(spark, folder), "concat"))


def hybrid_rerank(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(fusion.combine(*_lists(spark, folder), "rerank"))


def hybrid_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(fusion.combine(*_lists(spark, folder), "weighted", 2.0, 1.0))


def hybrid_expand(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.combine(*_lists(spark, folder), "expand").select("query_id", "id", "rank", "retrieval_source", "role")


def content_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.first_of_content(fusion.combine(*_lists(spark, folder), "concat")).select("query_id", "id", "rank", "retrieval_source")


def rerank_threshold(spark: SparkSession, folder: str) -> DataFrame:
    v = _near(spark, folder, 10)
    score = rerank.parse_score(F.concat(F.lit("Score: "), ((F.col("vec_id") * 7) % 11).cast("string"), F.lit(" out of 10")))
    return rerank.rerank(v, score, 5, 0.4).select("query_id", "vec_id", F.col("new_rank").alias("rank"), F.round("rerank_score", 6).alias("score"))


def cross_encoder_sigmoid(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).select("query_id", "vec_id", F.round(rerank.sigmoid(2 - F.col("distance")), 6).alias("score"))


def context_format(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.format_context(_lists(spark, folder)[0], 1500).select("query_id", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("context_md5"))


def prompt_build(spark: SparkSession, folder: str) -> DataFrame:
    v, _ = _lists(spark, folder)
    sources = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source")
    return fusion.build_prompt(v.join(sources, "id", "left")).select("query_id", F.md5("prompt").alias("prompt_md5"))


_L2 = """near AS (
    SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS distance
    FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0
), l2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near)"""
_COSINE = """cos_near AS (
    SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS distance
    FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0
), cosine AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, greatest(0, least(1, 1 - distance)) AS score FROM cos_near)"""
_LISTS = f"""WITH {_L2}, {_COSINE}, v AS (
    SELECT query_id, l2.vec_id AS id, rank AS own_rank, coalesce(text, '') AS page_content, 'vector' AS retrieval_source, 0 AS source_order, CAST(NULL AS DOUBLE) AS hop, CAST(NULL AS DOUBLE) AS relevance
    FROM l2 LEFT JOIN documents ON doc_id = l2.vec_id WHERE rank <= 5
), g AS (
    SELECT query_id, cosine.vec_id AS id, rank AS own_rank, coalesce(text, '') AS page_content, 'graph' AS retrieval_source, 1 AS source_order, CAST(rank % 3 AS DOUBLE) AS hop, round(score, 6) AS relevance
    FROM cosine LEFT JOIN documents ON doc_id = cosine.vec_id WHERE rank <= 6
), both_lists AS (SELECT * FROM v UNION ALL SELECT * FROM g)"""
_NONE = "CAST(NULL AS DOUBLE) AS score"

ORACLES = {
    "knn_l2_topk": f"WITH {_L2} SELECT query_id, vec_id, rank, round(distance, 6) AS distance, round(exp(-distance), 6) AS score, source, CAST(length(text) AS BIGINT) AS n_chars FROM l2 LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 8",
    "knn_cosine_topk": f"WITH {_COSINE} SELECT query_id, vec_id, rank, round(distance, 6) AS distance, round(score, 6) AS score FROM cosine WHERE rank <= 8",
    "knn_threshold": f"WITH {_COSINE} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM cosine WHERE rank <= 8 AND score >= 0.5",
    "mmr_topk": f"""WITH RECURSIVE {_COSINE}, cand AS (SELECT query_id, vec_id, rank, 1 - distance AS rel FROM cosine WHERE rank <= 10), alike AS (
        SELECT a.query_id, a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(CAST(u.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS sim
        FROM cand a JOIN cand b ON a.query_id = b.query_id JOIN embeddings u ON u.vec_id = a.vec_id JOIN embeddings v ON v.vec_id = b.vec_id
    ), pick(query_id, n, chosen) AS (
        SELECT query_id, 1, [vec_id] FROM cand WHERE rank = 1
        UNION ALL SELECT query_id, n + 1, list_append(chosen, vec_id) FROM (
            SELECT p.query_id, p.n, p.chosen, c.vec_id, row_number() OVER (PARTITION BY p.query_id ORDER BY round(0.5 * c.rel - 0.5 * max(a.sim), 12) DESC, c.rank) AS o
            FROM pick p JOIN cand c ON c.query_id = p.query_id AND NOT list_contains(p.chosen, c.vec_id) JOIN alike a ON a.query_id = p.query_id AND a.x = c.vec_id AND list_contains(p.chosen, a.y)
            WHERE p.n < 5 GROUP BY p.query_id, p.n, p.chosen, c.vec_id, c.rel, c.rank
        ) WHERE o = 1
    ), placed AS (SELECT query_id, unnest(chosen) AS vec_id, unnest(range(1, 6)) AS rank FROM pick WHERE n = 5)
    SELECT p.query_id, p.vec_id, CAST(p.rank AS INT) AS rank, round(c.rel, 6) AS relevance FROM placed p JOIN cand c ON c.query_id = p.query_id AND c.vec_id = p.vec_id""",
    "seed_embedding_nodes": f"""WITH {_L2}, {graphs.NODES_SQL}, s AS (
        SELECT query_id, node_id, l2.vec_id, exp(-distance) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, l2.vec_id, node_id) AS seed_rank FROM l2 JOIN nodes ON nodes.vec_id = l2.vec_id WHERE rank <= 10
    ) SELECT query_id, node_id, vec_id, round(score, 6) AS score, seed_rank FROM s WHERE seed_rank <= 5""",
    "orphan_nodes": f"WITH {graphs.NODES_SQL} SELECT type, count(*) AS n FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = n.vec_id) GROUP BY type",
    "hybrid_concat": f"{_LISTS} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY source_order, own_rank) AS rank, retrieval_source, {_NONE} FROM both_lists",
    "hybrid_rerank": f"""{_LISTS}, s AS (SELECT *, round(CASE WHEN source_order = 0 THEN CAST(0.8 AS DOUBLE) * (1 - (own_rank - 1) / CAST(count(*) OVER (PARTITION BY query_id, source_order) AS DOUBLE)) ELSE CAST(0.6 AS DOUBLE) * pow(CAST(0.7 AS DOUBLE), hop) * relevance END, 12) AS s FROM both_lists)
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source_order, own_rank) AS rank, retrieval_source, round(s, 6) AS score FROM s""",
    "hybrid_weighted": f"""{_LISTS}, d AS (SELECT *, floor(round(count(*) OVER (PARTITION BY query_id) * CASE WHEN source_order = 0 THEN CAST(2 AS DOUBLE) / 3 ELSE CAST(1 AS DOUBLE) / 3 END, 9)) AS due FROM both_lists)
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY own_rank, source_order) AS rank, retrieval_source, {_NONE} FROM d WHERE own_rank <= due""",
    "hybrid_expand": f"{_LISTS} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY source_order, own_rank) AS rank, retrieval_source, CASE WHEN source_order = 0 THEN 'core' ELSE 'context' END AS role FROM both_lists",
    "content_dedup": f"""{_LISTS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, md5(page_content) ORDER BY source_order, own_rank) AS n FROM both_lists)
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY source_order, own_rank) AS rank, retrieval_source FROM f WHERE n = 1""",
    "rerank_threshold": f"""WITH {_L2}, s AS (SELECT query_id, vec_id, rank, ((vec_id * 7) % 11) / CAST(10 AS DOUBLE) AS score FROM l2 WHERE rank <= 10), o AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS n FROM s WHERE score >= 0.4
    ) SELECT query_id, vec_id, n AS rank, round(score, 6) AS score FROM o WHERE n <= 5""",
    "cross_encoder_sigmoid": f"WITH {_L2} SELECT query_id, vec_id, round(1 / (1 + exp(distance - 2)), 6) AS score FROM l2 WHERE rank <= 8",
    "context_format": f"""{_LISTS}, b AS (SELECT query_id, own_rank, '[' || own_rank || '] ' || page_content AS block FROM v), r AS (
        SELECT *, 1500 - (sum(length(block)) OVER (PARTITION BY query_id ORDER BY own_rank) - length(block)) AS room FROM b
    ), c AS (SELECT query_id, own_rank, CASE WHEN length(block) > room THEN substr(block, 1, CAST(room AS INT)) || '...' ELSE block END AS block FROM r WHERE room > 0), a AS (
        SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY own_rank) AS context FROM c GROUP BY query_id
    ) SELECT query_id, CAST(length(context) AS BIGINT) AS n_chars, md5(context) AS context_md5 FROM a""",
    "prompt_build": f"""{_LISTS}, p AS (SELECT v.query_id, v.own_rank, 'Document ' || v.own_rank || ' (source: ' || coalesce(source, 'unknown') || '):' || chr(10) || page_content AS block FROM v LEFT JOIN documents ON doc_id = id)
        SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY own_rank)) AS prompt_md5 FROM p GROUP BY query_id""",
}
ORACLES |= {
    "knn_indexed_l2": f"WITH {_L2} SELECT query_id, vec_id, rank, round(distance, 6) AS distance, round(exp(-distance), 6) AS score FROM l2 WHERE rank <= 8",
    "knn_indexed_cosine": ORACLES["knn_cosine_topk"],
    "mmr_indexed": ORACLES["mmr_topk"],
    "seed_nodes_indexed": ORACLES["seed_embedding_nodes"],
}
QUERIES = {f.__name__: f for f in (knn_l2_topk, knn_cosine_topk, knn_indexed_l2, knn_indexed_cosine, mmr_indexed, seed_nodes_indexed, knn_threshold, mmr_topk, seed_embedding_nodes, orphan_nodes, hybrid_concat, hybrid_rerank, hybrid_weighted, hybrid_expand, content_dedup, rerank_threshold, cross_encoder_sigmoid, context_format, prompt_build)}
