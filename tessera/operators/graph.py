"""Property graphs as two tables, and searches over them for many queries at once.

nodes: node_id, type, name, vec_id (and any properties); edges: src, dst, type, weight. seeds: query_id, node_id, score.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import term_overlap
from tessera.operators.vectors import in_groups
from tessera.sources.tables import cut, folder_of

DECAY = 0.7
#: Texts that are scored against all nodes in one pass.
MOST_TEXTS = 1000
#: Rows that a task is dealt, about, where whole queries are dealt to tasks.
ROWS_A_TASK = 1_500_000


def by_query(rows: DataFrame, n: int) -> DataFrame:
    """rows (n of them) dealt by query to as many tasks as they need: what is joined, grouped or ranked within a query afterwards stays where it is."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(max(least, -(-n // ROWS_A_TASK)), "query_id")


def simple(edges: DataFrame) -> DataFrame:
    """One edge a (src, dst), the last by type order winning, as a simple directed graph keeps it."""
    return edges.groupBy("src", "dst").agg(F.max_by(F.struct("type", "weight"), F.struct("type", "weight")).alias("e")).select("src", "dst", "e.type", "e.weight")


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """First of each id, by type then name."""
    return nodes.withColumn("_n", F.row_number().over(Window.partitionBy("node_id").orderBy("type", "name"))).where("_n = 1").drop("_n")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """First of each (src, dst, type), with how many there were."""
    return edges.groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"), F.count("*").alias("mentions"))


def buckets_of(spark: SparkSession, edges: int, edges_a_bucket: int = 4_000_000) -> int:
    """Buckets for so many edges: no fewer than the session's shuffle partitions, so that a join never finds it cheaper to deal the edges anew."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-edges // edges_a_bucket))


def adjacency(edges: DataFrame, buckets: int | None = None, edges_a_bucket: int = 4_000_000, dealt: bool = False) -> DataFrame:
    """edges as a table bucketed and sorted by src: the levels of a search then join it where it lies, and only their own rows are shuffled.

    A file a bucket; the table is in the session's catalog and its files in the shared folder, both for the life of the application. buckets: by the number of edges if not given (buckets_of). dealt: edges are
    in as many partitions by src already."""
    spark = edges.sparkSession
    if buckets is None:
        edges = cut(edges)
        buckets = buckets_of(spark, edges.count(), edges_a_bucket)
    name = f"adjacency_{uuid.uuid4().hex}"
    path = folder_of(spark, "adjacency")
    (edges if dealt else edges.repartition(buckets, "src")).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "src").sortBy("src").saveAsTable(name)
    return spark.table(name)


def breadth_first(seeds: DataFrame, edges: DataFrame, hops: int = 2, decay: float = DECAY) -> DataFrame:
    """query_id, node_id, hop_distance, relevance_score of all nodes within hops, seeds at 0.

    A node is visited on the level that reaches it first, from the parent that was visited first there; a level h costs decay ** h on top of its parent's
    score. Levels are a loop of equi-joins; each is written once (and the next stops at one without rows), so the plan does not grow with depth. The visit order is (order of the parent, node id).
    """
    best = seeds.groupBy("query_id", "node_id").agg(F.max("score").alias("relevance_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "node_id")
    front = cut(best.withColumns({"hop_distance": F.lit(0), "visit": F.row_number().over(order)}).select("query_id", "node_id", "hop_distance", "relevance_score", "visit"))
    seen, out_edges = front, edges.select("src", "dst")  # repeats fall to the minimum below
    for h in range(1, hops + 1):
        reached = out_edges.join(front, front.node_id == out_edges.src).select("query_id", F.col("dst").alias("node_id"), F.col("visit").alias("parent"), "relevance_score")
        reached = by_query(reached, reached.count())
        first = reached.groupBy("query_id", "node_id").agg(F.min("parent").alias("parent"), F.min_by("relevance_score", "parent").alias("base"))
        fresh = first.join(seen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        by = Window.partitionBy("query_id").orderBy("parent", "node_id")
        front = cut(fresh.select("query_id", "node_id", F.lit(h).alias("hop_distance"), (F.col("base") * F.lit(decay**h)).alias("relevance_score"), F.row_number().over(by).alias("visit")))
        seen = seen.unionByName(front)
        if h < hops and front.isEmpty():
            break
    return seen.drop("visit")


def depth_first(seeds: DataFrame, edges: DataFrame, hops: int = 2, decay: float = DECAY, most_nodes: int | None = 10_000) -> DataFrame:
    """Depth-first visits: query_id, node_id, hop_distance, relevance_score, visit. Order matters, so each query's reachable part is walked in one
    task; more than most_nodes nodes of one query raise (None: no bound). Only nodes that are left again are found before, and their neighbours travel as one sorted list a node."""
    region = cut(breadth_first(seeds, edges, hops - 1).select("query_id", "node_id") if hops > 0 else seeds.select("query_id", "node_id").distinct())
    near = edges.select("src", "dst").join(region.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi") if hops > 0 else edges.select("src", "dst").limit(0)
    lists = near.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dsts"))
    inner = region.join(lists, region.node_id == lists.src).select("query_id", "src", "dsts")
    if most_nodes is not None:
        reached = inner.select("query_id", F.explode("dsts").alias("node_id")).union(region.select("query_id", "node_id")).distinct()
        if not reached.groupBy("query_id").count().where(F.col("count") > most_nodes).isEmpty():
            raise ValueError(f"more than {most_nodes} nodes to walk")
    starts = seeds.select("query_id", F.lit(None).cast("string").alias("src"), F.array("node_id").alias("dsts"), "score")
    rows = inner.withColumn("score", F.lit(None).cast("double")).unionByName(starts)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = pdf[pdf.src.notna()]
        links: dict[str, list[str]] = dict(zip(inside.src, inside.dsts, strict=True))
        first = pdf[pdf.src.isna()]
        first = first.assign(dst=[d[0] for d in first.dsts]).sort_values(["score", "dst"], ascending=[False, True])
        seen, out = set(), []
        for node, score in first[["dst", "score"]].itertuples(index=False):
            stack = [(node, 0, float(score))]
            while stack:
                at, hop, value = stack.pop()
                if at in seen:
                    continue
                seen.add(at)
                out.append((at, hop, value))
                if hop < hops:
                    stack += [(x, hop + 1, value * decay) for x in links.get(at, [])[::-1] if x not in seen]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "node_id": [x[0] for x in out], "hop_distance": [x[1] for x in out], "relevance_score": [x[2] for x in out], "visit": range(1, len(out) + 1)})

    return rows.groupBy("query_id").applyInPandas(walk, "query_id bigint, node_id string, hop_distance int, relevance_score double, visit int")


def incident(visited: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """The first edges (by type, then ends) of each visited node among visited nodes, in or out: two equi-joins, no OR. Once edges are found they are dealt by query, to as many tasks as they need."""
    v = visited.select("query_id", "node_id").distinct() if "hop_distance" not in visited.columns else visited.select("query_id", "node_id")  # breadth_first gives a node once
    n = visited.count()
    w = by_query(v, n).select(F.col("query_id").alias("q"), F.col("node_id").alias("n"))
    # before the joins, which multiply by queries: edges of visited nodes, and visited nodes that have any
    near = cut(edges.select("src", "type", "dst").join(v.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi").distinct())
    out = v.join(near, v.node_id == near.src).select("query_id", "src", "type", "dst")
    inner = by_query(out, n).join(w, (F.col("query_id") == F.col("q")) & (F.col("dst") == F.col("n")), "left_semi")
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    both = inner.select("query_id", F.explode(ends).alias("node_id"), "src", "type", "dst")
    place = F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy("type", "src", "dst"))
    return both.withColumn("edge_rank", place).where(F.col("edge_rank") <= most)


def property_lines(nodes: DataFrame, properties: list[str]) -> Column:
    """``  key: value`` lines of the properties that a node has, in the order given."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"  {p}: "), nodes[p].cast("string")) for p in properties))


def heading() -> Column:
    """The first line of a node's document."""
    return F.concat_ws(": ", F.coalesce("type", F.lit("Unknown")), F.coalesce("name", "node_id"))


def described(nodes: DataFrame, passages: DataFrame, of: Callable[[Column], Column], properties: list[str] | None = None) -> DataFrame:
    """Nodes with their properties as lines (shown) and what is asked of their source passage (page_content)."""
    shown = F.nullif(property_lines(nodes, properties), F.lit("")) if properties else F.lit(None).cast("string")
    about = nodes.select("node_id", "type", "name", "vec_id", shown.alias("shown"))
    texts = passages.select("vec_id", of(F.col("page_content")).alias("page_content"))
    return about.where("vec_id IS NOT NULL").join(texts, "vec_id", "left").unionByName(about.where("vec_id IS NULL").withColumn("page_content", F.lit(None).cast("string")))  # nodes without a vector would meet in one task


def node_documents(visited: DataFrame, nodes: DataFrame, edges: DataFrame, passages: DataFrame, most: int = 5, properties: list[str] | None = None, of: Callable[[Column], Column] | None = None) -> DataFrame:
    """A document a visited node: its source passage (passages: vec_id, page_content) if it has one, else "Type: name", its properties (columns of nodes) and its edges as lines.

    of: what of a document is asked for, if not its text (such as F.md5): found once a passage, so that texts do not travel with each query that visits them."""
    of = of or (lambda text: text)
    lines = incident(visited, edges, most).groupBy("query_id", "node_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_rank", F.concat_ws(" ", "src", "type", "dst").alias("line")))), lambda x: x["line"]), "\n").alias("lines")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "hop_distance", "node_id"))
    placed = by_query(visited, visited.count()).withColumn("rank", rank).join(lines, ["query_id", "node_id"], "left")  # ranked before anything long is joined
    rendered = F.concat_ws("\n", heading(), "shown", "lines")
    d = placed.join(described(nodes, passages, of, properties), "node_id", "left")
    return d.select("query_id", "node_id", F.coalesce("page_content", of(rendered)).alias("page_content"), F.col("page_content").isNotNull().alias("from_source"), "relevance_score", "hop_distance", "rank")


#: Properties that say nothing about a node's meaning (fixed names).
TECHNICAL = ("name", "vector_id", "chunk_id", "embedding_timestamp", "embedding_source")


def text_properties(nodes: DataFrame) -> list[str]:
    """String columns of nodes beside its own ones and technical ones."""
    return [f.name for f in nodes.schema if f.dataType.simpleString() == "string" and f.name not in ("node_id", "type", "vec_id", *TECHNICAL)]


def keyword_score(query: Column, name: Column, kind: Column, *properties: Column) -> Column:
    """Names, types and other properties against a query without fuzzy matching: a name in which the query stands scores 3, else 1.5 for the share of query terms it has; a type
    1; each other property 0.5, else 0.3 for the share."""
    has = lambda c: F.contains(F.lower(c), F.lower(query))
    score = F.when(has(name), F.lit(3.0)).otherwise(1.5 * term_overlap(query, name)) + F.when(has(kind), F.lit(1.0)).otherwise(F.lit(0.0))
    for p in properties:
        score = score + F.coalesce(F.when(has(p), F.lit(0.5)).otherwise(0.3 * term_overlap(query, p)), F.lit(0.0))
    return score


def keyword_seeds(queries: DataFrame, nodes: DataFrame, k: int, min_score: float = 1e-9, properties: list[str] | None = None) -> DataFrame:
    """Best nodes of each query (query_id, text) by keyword_score: a stated set of queries, in groups of at most MOST_TEXTS, against all nodes in one pass each."""

    def search(some: DataFrame) -> DataFrame:
        score = keyword_score(F.col("text"), F.col("name"), F.col("type"), *(F.col(p) for p in properties or []))
        scored = nodes.join(F.broadcast(some.select("query_id", "text"))).withColumn("score", score).where(F.col("score") >= min_score)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
        return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "node_id", "score", "rank")

    return in_groups(queries, MOST_TEXTS, search)


def partial_ratio(a: str, b: str) -> float:
    """Best Indel similarity, 0 to 100, of the shorter string with a window of the longer of the same length."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    most, whole, at_char = 0, (1 << len(short)) - 1, {}
    for i, c in enumerate(short):
        at_char[c] = at_char.get(c, 0) | 1 << i
    for at in range(len(long) - len(short) + 1):
        left = whole  # longest common subsequence, a bit for each character of short that is not in it
        for c in long[at : at + len(short)]:
            hit = left & at_char.get(c, 0)
            left = (left + hit | left - hit) & whole
        most = max(most, len(short) - left.bit_count())
    return 100.0 * most / len(short)


def text_seeds(queries: DataFrame, nodes: DataFrame, k: int, score: Callable[[str, pd.DataFrame], np.ndarray], columns: list[str], least: float, scale: float = 4.5) -> DataFrame:
    """query_id, node_id, score, rank of the best k nodes of each query by a raw score of (lower-case query, a batch of nodes) that is at least `least`, over scale and at most 1. A stated set of
    queries, in groups of at most MOST_TEXTS, one pass over all nodes each; a batch sends a query's best k only."""

    def search(some: DataFrame) -> DataFrame:
        given = [(r.query_id, r.text.lower()) for r in some.select("query_id", "text").collect()]

        def run(batches):
            for pdf in batches:
                for query_id, text in given:
                    raw = score(text, pdf)
                    found = pd.DataFrame({"query_id": query_id, "node_id": pdf["node_id"], "score": np.minimum(1.0, raw / scale)})
                    yield found[raw >= least].sort_values(["score", "node_id"], ascending=[False, True]).head(k)

        scored = nodes.select("node_id", *columns).mapInPandas(run, "query_id bigint, node_id string, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
        return scored.withColumn("rank", place).where(F.col("rank") <= k)

    return in_groups(queries, MOST_TEXTS, search)


def ratios(text: str, values: pd.Series) -> np.ndarray:
    """partial_ratio of a text with each value in lower case; each distinct value is compared once, null is 0."""
    known: dict = {}
    return np.array([known[v] if v in known else known.setdefault(v, partial_ratio(text, v.lower()) if isinstance(v, str) else 0.0) for v in values], float)


def fuzzy_seeds(queries: DataFrame, nodes: DataFrame, k: int, min_score: float = 0.0, properties: list[str] | None = None) -> DataFrame:
    """Seeds by partial ratios of name (0.03), type (0.01) and other string properties (0.005 each), over 4.5 and at most 1."""
    more = properties or []

    def score(text: str, pdf: pd.DataFrame) -> np.ndarray:
        return sum((0.005 * ratios(text, pdf[p]) for p in more), ratios(text, pdf["name"]) * 0.03 + ratios(text, pdf["type"]) * 0.01)

    return text_seeds(queries, nodes, k, score, ["name", "type", *more], 4.5 * min_score)


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    return n.join(e).withColumn("density", F.col("n_edges") / F.greatest(F.col("n_nodes") * (F.col("n_nodes") - 1), F.lit(1)))


def neighbours(edges: DataFrame, node_ids: list[str]) -> DataFrame:
    return edges.where(F.col("src").isin(node_ids)).select("src", "dst", "type").distinct()


def edge_data(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.where((F.col("src") == src) & (F.col("dst") == dst))


def contains(nodes: DataFrame, node_id: str) -> bool:
    return not nodes.where(F.col("node_id") == node_id).isEmpty()


def index(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes with their embedding (vectors: vec_id, embedding), cut so that many searches read one table."""
    return cut(nodes.join(vectors.select("vec_id", "embedding"), "vec_id"))


def stats(nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, nodes that have a vector id, those whose vector is there, and orphans."""
    held = vectors.select("vec_id").distinct().withColumn("held", F.lit(1))
    n = nodes.join(held, "vec_id", "left").agg(F.count("vec_id").alias("with_vector"), F.count("held").alias("indexed"), F.count(F.when(F.col("vec_id").isNotNull() & F.col("held").isNull(), 1)).alias("orphans"))
    return density(nodes, edges).join(n)
