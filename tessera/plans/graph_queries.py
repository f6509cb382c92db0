"""Registered graph searches over the relational tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, neighbourhoods, pagerank
from tessera.operators.name_index import NameIndex
from tessera.plans import graphs
from tessera.sources.tables import table


_made: dict[tuple[str, str], DataFrame] = {}


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges, bucketed by src once a session and folder, for all levels of all searches."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _made:
        _made[key] = graph.adjacency(graphs.edges(spark, folder))
    return _made[key]


def _customer_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer whose key is divisible by 50 is a query (a stated query set that grows with the table)."""
    c = table(spark, folder, "customer").where("c_custkey % 50 = 0")
    return c.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit(1.0).alias("score"))


def _region_seeds(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "region")
    return r.select(F.col("r_regionkey").cast("bigint").alias("query_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit(1.0).alias("score"))


def bfs_2hop(spark: SparkSession, folder: str) -> DataFrame:
    return graph.breadth_first(_customer_seeds(spark, folder), _edges(spark, folder), 2).groupBy("query_id", "hop_distance").agg(F.count("*").alias("n"))


def bfs_decay_scores(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.breadth_first(_region_seeds(spark, folder), _edges(spark, folder), 3)
    return found.select("query_id", "node_id", "hop_distance", F.round("relevance_score", 6).alias("relevance_score"))


def dfs_visits(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.depth_first(_customer_seeds(spark, folder), _edges(spark, folder), 2, most_nodes=None)
    return found.select("query_id", "node_id", "hop_distance", F.round("relevance_score", 6).alias("relevance_score"), "visit")


def subgraph_edges_top5(spark: SparkSession, folder: str) -> DataFrame:
    return neighbourhoods.incident_edges(_customer_seeds(spark, folder), _edges(spark, folder), 2).select("query_id", "node_id", "src", "type", "dst", "edge_rank")


def graph_docs_with_source(spark: SparkSession, folder: str) -> DataFrame:
    passages = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("page_content"))
    d = neighbourhoods.documents(_customer_seeds(spark, folder), graphs.nodes(spark, folder), _edges(spark, folder), passages, 2, of=F.md5)
    return d.select("query_id", "node_id", "rank", "from_source", "hop_distance", F.round("relevance_score", 6).alias("relevance_score"), F.col("page_content").alias("content_md5"))


def keyword_seed_overlap(spark: SparkSession, folder: str) -> DataFrame:
    queries = spark.createDataFrame([(1, "Region"), (2, "supplier"), (3, "asia east"), (4, "customer 1")], "query_id bigint, text string")
    found = graph.keyword_seeds(queries, graphs.nodes(spark, folder), 5)
    return found.select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


def fuzzy_seed_nodes(spark: SparkSession, folder: str) -> DataFrame:
    queries = spark.createDataFrame([(1, "ASIA"), (2, "nation")], "query_id bigint, text string")
    return graph.fuzzy_seeds(queries, graphs.nodes(spark, folder), 5).select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


def _part_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The name of each part whose key is divisible by 50 is a query."""
    return table(spark, folder, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("bigint").alias("query_id"), F.col("p_name").alias("text"))


def keyword_names(spark: SparkSession, folder: str) -> DataFrame:
    found = NameIndex(graphs.nodes(spark, folder)).keyword(_part_texts(spark, folder), 5)
    return found.select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


def fuzzy_names(spark: SparkSession, folder: str) -> DataFrame:
    found = NameIndex(graphs.nodes(spark, folder)).fuzzy(_part_texts(spark, folder), 5)
    return found.select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


#: Least residual a link that is pushed, and rounds, of ppr_push.
LEAST_PUSHED, PUSH_ROUNDS = 0.001, 12


def ppr_push(spark: SparkSession, folder: str) -> DataFrame:
    found = pagerank.forward_push(_customer_seeds(spark, folder), pagerank.transitions(graphs.edges(spark, folder)), 0.15, LEAST_PUSHED, PUSH_ROUNDS)
    return found.select("query_id", "node_id", F.round("score", 6).alias("score"), F.round("rank_mass", 6).alias("rank_mass"), F.round("residual", 6).alias("residual"))


def ppr_scores(spark: SparkSession, folder: str) -> DataFrame:
    found = pagerank.personalised_pagerank(_customer_seeds(spark, folder), _edges(spark, folder))
    return found.select("query_id", "node_id", F.round("score", 6).alias("score"))


def ppr_topk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = pagerank.personalised_pagerank(_customer_seeds(spark, folder), _edges(spark, folder)).withColumn("score", F.round("score", 6))
    best = pagerank.best_vectors(found, graphs.nodes(spark, folder), 5, 0.01, ["nation", "supplier"])
    return best.select("query_id", "rank", "vec_id", "node_id", "score", "retrieval_source")


def node_dedup(spark: SparkSession, folder: str) -> DataFrame:
    n = graphs.nodes(spark, folder)
    return graph.distinct_nodes(n.union(n.withColumn("type", F.lower("type")))).groupBy("type").agg(F.count("*").alias("n"))


def edge_dedup(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("weight"))
    return graph.distinct_edges(lines).select("src", "dst", "type", "weight", "mentions")


def simple_edges(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("weight"))
    return graph.simple(lines)


def graph_density(spark: SparkSession, folder: str) -> DataFrame:
    d = graph.density(graphs.nodes(spark, folder), graphs.edges(spark, folder))
    return d.select("n_nodes", "n_edges", F.round("density", 9).alias("density"))


def type_histogram(spark: SparkSession, folder: str) -> DataFrame:
    n = graphs.nodes(spark, folder).groupBy("type").agg(F.count("*").alias("n"), F.count("vec_id").alias("with_vector"))
    e = graphs.edges(spark, folder).groupBy("type").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("with_vector"))
    return n.withColumn("kind", F.lit("node")).unionByName(e.withColumn("kind", F.lit("edge")))


_CUSTOMERS = "seeds AS (SELECT c_custkey AS query_id, 'c' || c_custkey AS node_id FROM customer WHERE c_custkey % 50 = 0)"
_REGIONS = "seeds AS (SELECT CAST(r_regionkey AS BIGINT) AS query_id, 'r' || r_regionkey AS node_id FROM region)"


def _walk(seeds: str, hops: int) -> str:
    return f"""WITH RECURSIVE {graphs.EDGES_SQL}, {seeds}, walk(query_id, node_id, hop) AS (
        SELECT query_id, node_id, 0 FROM seeds UNION SELECT w.query_id, e.dst, w.hop + 1 FROM walk w JOIN edges e ON e.src = w.node_id WHERE w.hop < {hops}
    ), visited AS (SELECT query_id, node_id, CAST(min(hop) AS INT) AS hop_distance, pow(CAST(0.7 AS DOUBLE), min(hop) * (min(hop) + 1) / 2) AS relevance_score FROM walk GROUP BY query_id, node_id)"""


_INCIDENT = """inner_edges AS (
        SELECT DISTINCT v.query_id, e.src, e.type, e.dst FROM visited v JOIN edges e ON e.src = v.node_id JOIN visited w ON w.query_id = v.query_id AND w.node_id = e.dst
    ), both_ways AS (SELECT query_id, src AS node_id, src, type, dst FROM inner_edges UNION ALL SELECT query_id, dst, src, type, dst FROM inner_edges WHERE src <> dst),
    incident AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY type, src, dst) AS edge_rank FROM both_ways) WHERE edge_rank <= 5)"""

_PPR = f"""{_walk(_CUSTOMERS, 3)}, kept AS (
        SELECT query_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop_distance, node_id) AS place FROM visited) WHERE place <= 200 OR hop_distance = 0
    ), inner_edges AS (
        SELECT k.query_id, e.src, e.dst, e.weight FROM kept k JOIN edges e ON e.src = k.node_id JOIN kept o ON o.query_id = k.query_id AND o.node_id = e.dst WHERE e.src <> e.dst
    ), adj AS (SELECT query_id, src, dst, max(weight) AS weight FROM (SELECT * FROM inner_edges UNION ALL SELECT query_id, dst, src, weight FROM inner_edges) GROUP BY ALL),
    p AS (SELECT *, weight / sum(weight) OVER (PARTITION BY query_id, src) AS share FROM adj),
    teleport AS (SELECT k.query_id, k.node_id, CASE WHEN s.node_id IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS t FROM kept k LEFT JOIN seeds s ON s.query_id = k.query_id AND s.node_id = k.node_id),
    flow AS (SELECT query_id, src, dst, share FROM p UNION ALL SELECT query_id, node_id, node_id, CAST(0 AS DOUBLE) FROM kept),
    ranks(i, query_id, node_id, x) AS (
        SELECT 0, query_id, node_id, t FROM teleport
        UNION ALL SELECT r.i + 1, f.query_id, f.dst, CAST(0.15 AS DOUBLE) * max(t.t) + CAST(0.85 AS DOUBLE) * sum(r.x * f.share)
        FROM ranks r JOIN flow f ON f.query_id = r.query_id AND f.src = r.node_id JOIN teleport t ON t.query_id = f.query_id AND t.node_id = f.dst WHERE r.i < 50 GROUP BY r.i, f.query_id, f.dst
    ), scores AS (SELECT query_id, node_id, round(x / max(x) OVER (PARTITION BY query_id), 6) AS score FROM ranks WHERE i = 50)"""

ORACLES = {
    "bfs_2hop": f"{_walk(_CUSTOMERS, 2)} SELECT query_id, hop_distance, count(*) AS n FROM visited GROUP BY ALL",
    "bfs_decay_scores": f"{_walk(_REGIONS, 3)} SELECT query_id, node_id, hop_distance, round(relevance_score, 6) AS relevance_score FROM visited",
    "subgraph_edges_top5": f"{_walk(_CUSTOMERS, 2)}, {_INCIDENT} SELECT * FROM incident",
    "graph_docs_with_source": f"""{_walk(_CUSTOMERS, 2)}, {graphs.NODES_SQL}, {_INCIDENT}, lines AS (
        SELECT query_id, node_id, string_agg(src || ' ' || type || ' ' || dst, chr(10) ORDER BY edge_rank) AS lines FROM incident GROUP BY ALL
    ) SELECT v.query_id, v.node_id, row_number() OVER (PARTITION BY v.query_id ORDER BY relevance_score DESC, hop_distance, v.node_id) AS rank, text IS NOT NULL AS from_source, hop_distance, round(relevance_score, 6) AS relevance_score,
        md5(coalesce(text, concat_ws(chr(10), coalesce(type, 'Unknown') || ': ' || coalesce(name, v.node_id), lines))) AS content_md5
    FROM visited v LEFT JOIN nodes n ON n.node_id = v.node_id LEFT JOIN documents d ON d.doc_id = n.vec_id LEFT JOIN lines l ON l.query_id = v.query_id AND l.node_id = v.node_id""",
    "keyword_seed_overlap": f"""WITH {graphs.NODES_SQL}, queries(query_id, text) AS (VALUES (1, 'Region'), (2, 'supplier'), (3, 'asia east'), (4, 'customer 1')),
    terms AS (SELECT q.*, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n]+'), lambda x: x <> '')) AS t FROM queries q),
    scored AS (SELECT query_id, node_id, CASE WHEN contains(lower(name), lower(text)) THEN CAST(3 AS DOUBLE)
        ELSE CAST(1.5 AS DOUBLE) * len(list_intersect(t, list_distinct(list_filter(string_split_regex(lower(name), '[ \\t\\n]+'), lambda x: x <> '')))) / greatest(len(t), 1) END
        + CASE WHEN contains(lower(type), lower(text)) THEN 1 ELSE 0 END AS score FROM nodes, terms),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM scored WHERE score > 0)
    SELECT CAST(query_id AS BIGINT) AS query_id, node_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5""",
    "ppr_scores": f"{_PPR} SELECT query_id, node_id, score FROM scores",
    "ppr_topk_vectors": f"""{_PPR}, {graphs.NODES_SQL}, c AS (
        SELECT s.query_id, n.vec_id, s.node_id, s.score, row_number() OVER (PARTITION BY s.query_id, n.vec_id ORDER BY s.score DESC, s.node_id) AS once FROM scores s JOIN nodes n ON n.node_id = s.node_id
        WHERE n.vec_id IS NOT NULL AND s.score >= 0.01 AND lower(n.type) IN ('nation', 'supplier')
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM c WHERE once = 1)
    SELECT query_id, rank, vec_id, node_id, score, 'pagerank' AS retrieval_source FROM r WHERE rank <= 5""",
    "node_dedup": f"""WITH {graphs.NODES_SQL}, d AS (SELECT node_id, type, name FROM nodes UNION ALL SELECT node_id, lower(type), name FROM nodes), f AS (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY type, name) AS n FROM d) SELECT type, count(*) AS n FROM f WHERE n = 1 GROUP BY type""",
    "edge_dedup": "SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS type, max(l_quantity) AS weight, count(*) AS mentions FROM lineitem GROUP BY ALL",
    "simple_edges": "SELECT l_suppkey AS src, l_partkey AS dst, max({'type': l_returnflag, 'weight': l_quantity}).type AS type, max({'type': l_returnflag, 'weight': l_quantity}).weight AS weight FROM lineitem GROUP BY l_suppkey, l_partkey",
    "graph_density": f"WITH {graphs.NODES_SQL}, {graphs.EDGES_SQL} SELECT n AS n_nodes, e AS n_edges, round(e / CAST(greatest(n * (n - 1), 1) AS DOUBLE), 9) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS e FROM edges)",
    "type_histogram": f"WITH {graphs.NODES_SQL}, {graphs.EDGES_SQL} SELECT type, count(*) AS n, count(vec_id) AS with_vector, 'node' AS kind FROM nodes GROUP BY type UNION ALL SELECT type, count(*), 0, 'edge' FROM edges GROUP BY type",
}
ORACLES |= {
    "keyword_names": ORACLES["keyword_seed_overlap"].replace("queries(query_id, text) AS (VALUES (1, 'Region'), (2, 'supplier'), (3, 'asia east'), (4, 'customer 1'))", "queries AS (SELECT p_partkey AS query_id, p_name AS text FROM part WHERE p_partkey % 50 = 0)"),
    "ppr_push": f"""WITH RECURSIVE {graphs.EDGES_SQL}, {_CUSTOMERS}, adj AS (
        SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM edges WHERE src <> dst UNION ALL SELECT dst, src, weight FROM edges WHERE src <> dst) GROUP BY ALL
    ), degrees AS (SELECT src, count(*) AS degree, sum(weight) AS w FROM adj GROUP BY src),
    flow AS (SELECT a.src, a.dst, a.weight / d.w AS share, d.degree FROM adj a JOIN degrees d ON d.src = a.src UNION ALL SELECT src, src, CAST(-1 AS DOUBLE), degree FROM degrees),
    state(i, query_id, node_id, p, r) AS (
        SELECT 0, query_id, node_id, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM seeds
        UNION ALL SELECT s.i + 1, s.query_id, f.dst, sum(CASE WHEN share < 0 THEN s.p + CASE WHEN s.r >= {LEAST_PUSHED} * degree THEN CAST(0.15 AS DOUBLE) * s.r ELSE 0 END ELSE 0 END),
            sum(CASE WHEN share < 0 THEN CASE WHEN s.r >= {LEAST_PUSHED} * degree THEN 0 ELSE s.r END ELSE CAST(0.85 AS DOUBLE) * s.r * share END)
        FROM state s JOIN flow f ON f.src = s.node_id AND (share < 0 OR s.r >= {LEAST_PUSHED} * degree) WHERE s.i < {PUSH_ROUNDS} GROUP BY s.i, s.query_id, f.dst
    ), last AS (SELECT * FROM state WHERE i = {PUSH_ROUNDS})
    SELECT query_id, node_id, round((p + r) / max(p + r) OVER (PARTITION BY query_id), 6) AS score, round(p + r, 6) AS rank_mass, round(sum(r) OVER (PARTITION BY query_id), 6) AS residual FROM last""",
}
QUERIES = {f.__name__: f for f in (keyword_names, fuzzy_names, ppr_push, bfs_2hop, bfs_decay_scores, dfs_visits, subgraph_edges_top5, graph_docs_with_source, keyword_seed_overlap, fuzzy_seed_nodes, ppr_scores, ppr_topk_vectors, node_dedup, edge_dedup, simple_edges, graph_density, type_histogram)}
