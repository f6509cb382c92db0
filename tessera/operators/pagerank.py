"""Personalised PageRank over the neighbourhood of each query's seeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import adjacency, buckets_of, by_query, ratios, text_seeds
from tessera.sources.tables import cut

#: Share of the residual that makes a node push, from which a push keeps its links for later rounds.
SOON = 0.25


def nearest_nodes(seeds: DataFrame, edges: DataFrame, hops: int, most: int) -> DataFrame:
    """query_id, node_id of the first `most` nodes of each query within hops, by hop and id, and of all its seeds: what breadth_first finds, cut by that order, without finding the rest.

    A query whose nodes reach `most` goes no further, and of a node's neighbours only the first `most` by id are looked at: fewer than that are already seen, so the rest cannot be among the first. So rows grow
    with the queries and not with the degree of nodes."""
    front = cut(seeds.select("query_id", "node_id").distinct())
    seen, links = front, edges.select("src", "dst")
    by_id = Window.partitionBy("src").orderBy("dst")
    for h in range(1, hops + 1):
        near = links.join(front.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi").distinct().withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= most)
        reached = near.join(front, front.node_id == near.src).select("query_id", F.col("dst").alias("node_id")).distinct()
        fresh = reached.join(seen, ["query_id", "node_id"], "left_anti").join(seen.groupBy("query_id").agg(F.count("*").alias("had")), "query_id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("node_id"))
        level = cut(fresh.withColumn("place", place).where(F.col("place") + F.col("had") <= most).select("query_id", "node_id"))
        seen = seen.union(level)
        full = seen.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= most)
        front = level.join(full, "query_id", "left_anti")
        if h < hops:
            front = cut(front)
            if front.isEmpty():
                break
    return seen


def local_graph(seeds: DataFrame, edges: DataFrame, hops: int = 3, most_nodes: int = 200) -> DataFrame:
    """query_id, src, dst, weight among a query's nodes, both ways round: nodes within hops, at most most_nodes (nearest first, seeds always), edges
    only between nodes that are kept, the greater weight if a direction has several; a seed without edges keeps a row with dst null.

    Edges of a node with more than most_nodes neighbours are looked up by pairs of kept nodes, those of others are followed."""
    kept = cut(nearest_nodes(seeds, edges, hops, most_nodes))
    e = edges.select("src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight")).where("src <> dst")
    e = cut(e.join(kept.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi").groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    hubs = cut(e.groupBy("src").count().where(F.col("count") > most_nodes).select("src"))
    other = kept.select(F.col("query_id").alias("q"), F.col("node_id").alias("n"))
    light = kept.join(e.join(hubs, "src", "left_anti"), F.col("node_id") == F.col("src")).join(other, (F.col("query_id") == F.col("q")) & (F.col("dst") == F.col("n"))).select("query_id", "src", "dst", "weight")
    pairs = kept.join(hubs, F.col("node_id") == F.col("src")).select("query_id", "src").join(kept.select("query_id", F.col("node_id").alias("dst")), "query_id")
    inner = light.union(pairs.join(e.join(hubs, "src", "left_semi"), ["src", "dst"]).select("query_id", "src", "dst", "weight"))
    both = cut(inner.union(inner.select("query_id", "dst", "src", "weight")).groupBy("query_id", "src", "dst").agg(F.max("weight").alias("weight")))
    alone = kept.join(both.select("query_id", F.col("src").alias("node_id")).distinct(), ["query_id", "node_id"], "left_anti")
    return both.unionByName(alone.select("query_id", F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("weight")))


def rank_vector(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, teleport: np.ndarray, alpha: float, iterations: int, tolerance: float) -> np.ndarray:
    out = np.bincount(src, weight, n)
    x = teleport.copy()
    for _ in range(iterations):
        share = np.divide(x, out, out=np.zeros(n), where=out > 0)
        after = alpha * teleport + (1 - alpha) * (np.bincount(dst, weight * share[src], n) + x[out == 0].sum() / n)
        moved, x = np.abs(after - x).sum(), after
        if moved < tolerance:
            break
    return x


def personalised_pagerank(seeds: DataFrame, edges: DataFrame, alpha: float = 0.15, iterations: int = 50, tolerance: float = 0.0, hops: int = 3, most_nodes: int = 200) -> DataFrame:
    """query_id, node_id, score (over the greatest of its query). One query's bounded graph a task; all iterations are fixed unless a tolerance is given."""
    local = local_graph(seeds, edges, hops, most_nodes)
    marks = seeds.select("query_id", F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("score").cast("double").alias("weight"), F.lit(True).alias("seed"))
    rows = local.withColumn("seed", F.lit(False)).unionByName(marks)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links, marked = pdf[~pdf.seed & pdf.dst.notna()], pdf[pdf.seed]
        names = sorted(set(pdf.src) | set(links.dst))
        number = {x: i for i, x in enumerate(names)}
        teleport = np.zeros(len(names))
        np.add.at(teleport, [number[x] for x in marked.src], marked.weight.to_numpy(float))
        if teleport.sum() <= 0:
            teleport[[number[x] for x in marked.src]] = 1.0
        teleport /= teleport.sum()
        x = rank_vector(len(names), links.src.map(number).to_numpy(int), links.dst.map(number).to_numpy(int), links.weight.to_numpy(float), teleport, alpha, iterations, tolerance)
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "node_id": names, "score": x / max(x.max(), 1e-300)})

    # dealt by number, as the rows are few bytes and would be put into one task
    return by_query(rows, local.count()).groupBy("query_id").applyInPandas(run, "query_id bigint, node_id string, score double")


def transitions(edges: DataFrame) -> DataFrame:
    """src, dst, share, dst_degree: what of a node's rank goes to each neighbour, edges both ways round, the greater weight if a direction has several, none to itself; bucketed by src."""
    e = cut(edges.select("src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight")).where("src <> dst"))
    buckets = buckets_of(edges.sparkSession, 2 * e.count())
    of_src = Window.partitionBy("src")
    # dealt by one end, where its degree is counted, then by the other, where its weights are added up: links are the same both ways round
    both = e.union(e.select("dst", "src", "weight")).repartition(buckets, "src").groupBy("src", "dst").agg(F.max("weight").alias("weight")).withColumn("degree", F.count("*").over(of_src))
    turned = both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.col("degree").alias("dst_degree")).repartition(buckets, "src")
    return adjacency(turned.select("src", "dst", (F.col("weight") / F.sum("weight").over(of_src)).alias("share"), "dst_degree"), buckets, dealt=True)


def forward_push(seeds: DataFrame, links: DataFrame, alpha: float = 0.15, least: float = 1e-4, rounds: int = 50) -> DataFrame:
    """query_id, node_id, score (over the greatest of its query), rank_mass, residual (the query's): personalised PageRank by forward push (Andersen, Chung and Lang 2006) over the whole graph, all queries at once.

    A node holds rank p and residual r; at first r is the seeds' share. In a round every node with ``r >= least * degree`` keeps alpha of its residual as rank and deals the rest to its neighbours: a join of the nodes that
    push with their links, and one sum by query and node. Links of nodes that have pushed are kept; all links (see transitions) are read only in rounds in which a node pushes that has not yet, and those of nodes that
    are within SOON of pushing are kept too, so later rounds seldom read all. A query touches at most ``1 / (alpha * least)`` edges a unit of seed mass, however large the graph is, and no query's nodes meet in one
    task. rank_mass is p + r: what the power iteration holds after so many rounds if least is 0. The exact rank lies within 2 * residual of it (sum of differences over all nodes). Nodes without links keep their
    residual. Each round is written, so plans do not grow.
    """
    total = seeds.groupBy("query_id").agg(F.sum("score").alias("all"), F.countDistinct("node_id").alias("n"))
    start = seeds.groupBy("query_id", "node_id").agg(F.sum(F.col("score").cast("double")).alias("score")).join(total, "query_id")
    r = F.when(F.col("all") > 0, F.col("score") / F.col("all")).otherwise(1 / F.col("n"))

    def links_of(nodes: DataFrame) -> DataFrame:
        return cut(links.join(nodes.select(F.col("node_id").alias("wanted")), F.col("src") == F.col("wanted"), "left_semi"))

    known = cut(seeds.select("node_id").distinct())
    held = links_of(known)
    degrees = held.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "node_id")
    state = start.select("query_id", "node_id", F.lit(0.0).alias("p"), r.alias("r")).join(degrees, "node_id", "left")
    state = cut(state.select("query_id", "node_id", "p", "r", F.coalesce("degree", F.lit(0).cast("long")).alias("degree")))
    within = lambda share: (F.col("degree") > 0) & (F.col("r") > 0) & (F.col("r") >= share * least * F.col("degree"))
    pushes = within(1.0)
    for _ in range(rounds):
        active = state.where(pushes)
        if active.isEmpty():
            break
        if not active.join(known, "node_id", "left_anti").isEmpty():
            fresh = cut(state.where(within(SOON)).select("node_id").distinct().join(known, "node_id", "left_anti"))
            known, held = known.union(fresh), held.union(links_of(fresh))
        dealt = held.join(active.select("query_id", "node_id", "r"), F.col("src") == F.col("node_id"))
        dealt = dealt.select("query_id", F.col("dst").alias("node_id"), F.lit(0.0).alias("p"), ((1 - alpha) * F.col("r") * F.col("share")).alias("r"), F.col("dst_degree").alias("degree"))
        stays = state.select("query_id", "node_id", (F.col("p") + F.when(pushes, alpha * F.col("r")).otherwise(0.0)).alias("p"), F.when(pushes, 0.0).otherwise(F.col("r")).alias("r"), "degree")
        state = cut(stays.union(dealt).groupBy("query_id", "node_id").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.max("degree").alias("degree")))
    mass = F.col("p") + F.col("r")
    whole = state.groupBy("query_id").agg(F.max(mass).alias("most"), F.sum(F.when(F.col("degree") > 0, F.col("r")).otherwise(0.0)).alias("residual"))
    return state.join(whole, "query_id").select("query_id", "node_id", (mass / F.greatest("most", F.lit(1e-300))).alias("score"), mass.alias("rank_mass"), "residual")


def best_vectors(ranks: DataFrame, nodes: DataFrame, k: int, min_score: float = 0.0, types: list[str] | None = None) -> DataFrame:
    """The k best vectors of each query: nodes with a vector, of the types given (in any case), each vector once."""
    r = ranks.where(F.col("score") >= min_score).join(nodes.select("node_id", "type", "vec_id"), "node_id").where("vec_id IS NOT NULL")
    if types is not None:
        r = r.where(F.lower("type").isin([t.lower() for t in types]))
    once = Window.partitionBy("query_id", "vec_id").orderBy(F.desc("score"), "node_id")
    r = r.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
    return r.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "node_id", "score", F.lit("pagerank").alias("retrieval_source"))


def keyword_seeds(queries: DataFrame, nodes: DataFrame, k: int = 5, min_score: float = 0.0) -> DataFrame:
    """Seeds by name (0.03 of its partial ratio) and type (0.1 if it is a term of the query); min_score is of the raw score, the result is over 4.5 and at most 1."""

    def score(text: str, pdf: pd.DataFrame) -> np.ndarray:
        terms = set(text.split())
        return ratios(text, pdf["name"]) * 0.03 + 0.1 * pdf["type"].fillna("").str.lower().isin(terms).to_numpy()

    return text_seeds(queries, nodes, k, score, ["name", "type"], min_score)


def chunk_seeds(chunks: DataFrame, nodes: DataFrame, default: float = 0.5) -> DataFrame:
    """Nodes of retrieved chunks (query_id, rank, vec_id, score): query_id, node_id, score of the first chunk with the node's vector, default where it has none."""
    first = Window.partitionBy("query_id", "vec_id").orderBy("rank")
    once = chunks.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return once.join(nodes.select("node_id", "vec_id"), "vec_id").select("query_id", "node_id", F.coalesce("score", F.lit(default)).alias("score"))
