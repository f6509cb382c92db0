"""Lookups of names, bucketed edges and forward push, each against the plain way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import graph, pagerank
from tessera.operators.name_index import NameIndex, by_term

WORDS = ["red", "blue", "small", "ring", "widget", "asia", "east", "Customer", "Order", "gear", "bolt", "x"]


def some_nodes(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        name = rnd.choice([" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 5))), f"Order {i}", f"n{i % 7}", "aaaa", "", "é中 " + rnd.choice(WORDS), None])
        rows.append((f"k{i}", name, rnd.choice(["Part", "Region", "Order", None]), rnd.choice(["about red boats", None, "gear"])))
    return spark.createDataFrame(rows, "node_id string, name string, type string, about string").repartition(3).cache()


def some_texts(spark):
    texts = ["red ring", "Blue Widget small", "order 77", "asia", "a", "", "customer east gear bolt x", "zzz qqq", "aaaaa", "n3", "smal rign", None, "widget gear ring bolt small red blue asia"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.node_id, round(r.score, 12)) for r in df.collect())


@pytest.mark.parametrize("k,least,properties", [(1, 0.0, None), (5, 0.0, None), (5, 3.2, None), (4, 0.0, ["about"]), (500, 0.0, None)])
def test_fuzzy_lookup_equals_comparing_all(spark, k, least, properties):
    nodes, texts = some_nodes(spark), some_texts(spark).where("text IS NOT NULL")
    want = graph.fuzzy_seeds(texts, nodes, k, least / 4.5, properties)
    assert rows(NameIndex(nodes).fuzzy(some_texts(spark), k, 4.5 * (least / 4.5), properties=properties)) == rows(want)


def test_fuzzy_lookup_by_terms_of_types(spark):
    nodes, texts = some_nodes(spark, seed=5), some_texts(spark).where("text IS NOT NULL")
    assert rows(NameIndex(nodes).fuzzy(texts, 5, 1.0, type_score=by_term)) == rows(pagerank.keyword_seeds(texts, nodes, 5, 1.0))


def test_few_names_are_compared(spark):
    from tessera.plans import graph_queries, graphs

    folder = "/root/testdata/sf0.001"
    nodes = graphs.nodes(spark, folder)
    index, texts = NameIndex(nodes), graph_queries._part_texts(spark, folder)
    n = index.names.count()
    pairs = index.compared(texts, 5).agg(F.avg("compared"), F.count("*")).first()
    assert pairs[1] == texts.count() and pairs[0] < 0.1 * n
    assert rows(index.fuzzy(texts, 5)) == rows(graph.fuzzy_seeds(texts, nodes, 5))


@pytest.mark.parametrize("k", [1, 6])
def test_keyword_lookup_equals_scoring_all(spark, k):
    nodes, texts = some_nodes(spark, seed=9), some_texts(spark).where("text IS NOT NULL")
    assert rows(NameIndex(nodes).keyword(some_texts(spark), k)) == rows(graph.keyword_seeds(texts, nodes, k))


def test_no_names_at_all(spark):
    nodes = some_nodes(spark).limit(0)
    assert NameIndex(nodes).fuzzy(some_texts(spark), 3).count() == 0 and NameIndex(nodes).keyword(some_texts(spark), 3).count() == 0


def some_edges(spark, n=60, m=150, seed=1):
    rnd = random.Random(seed)
    made = [(f"v{rnd.randrange(n)}", f"v{rnd.randrange(n)}", "E", rnd.choice([None, 1.0, 2.5])) for _ in range(m)]
    return spark.createDataFrame(made, "src string, dst string, type string, weight double")


def test_edges_are_joined_where_they_lie(spark):
    """No level's plan deals edges anew, whether the frontier is sent to all or dealt."""
    edges = graph.adjacency(some_edges(spark))
    front = spark.createDataFrame([(1, "v1", 1.0)], "query_id bigint, node_id string, score double")
    for hint in ("broadcast", "merge", "shuffle_hash"):
        joined = edges.select("src", "dst").join(front.hint(hint), F.col("node_id") == F.col("src"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "adjacency_" in plan
        if hint != "broadcast":
            assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(node_id" in plan and "Bucketed: true" in plan
        else:
            assert "Exchange hashpartitioning" not in plan


def test_every_level_of_a_search_leaves_edges_in_place(spark, monkeypatch):
    plans = []
    real = graph.cut

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    edges = graph.adjacency(some_edges(spark))
    seeds = spark.createDataFrame([(1, "v1", 1.0), (2, "v5", 0.5)], "query_id bigint, node_id string, score double")
    monkeypatch.setattr(graph, "cut", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sorted(map(tuple, graph.breadth_first(seeds, edges, 3).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    levels = [p for p in plans if "adjacency_" in p]
    assert len(levels) == 3 and all("hashpartitioning(src" not in p and "Bucketed: true" in p for p in levels)
    assert found == sorted(map(tuple, graph.breadth_first(seeds, some_edges(spark), 3).collect()))


def walk(edges, seeds, alpha, rounds):
    """Power iteration over the whole graph, seeds: node -> share."""
    w = {}
    for s, d, weight in edges:
        if s != d:
            for key in ((s, d), (d, s)):
                w[key] = max(w.get(key, 0.0), 1.0 if weight is None else weight)
    names = sorted({x for key in w for x in key} | set(seeds))
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for (s, d), weight in w.items():
        m[at[d], at[s]] = weight
    out = m.sum(0)
    m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    t = np.zeros(len(names))
    for x, share in seeds.items():
        t[at[x]] = share
    x = t.copy()
    for _ in range(rounds):
        x = alpha * t + (1 - alpha) * (m @ x)
    return dict(zip(names, x, strict=True))


def test_push_of_all_equals_the_power_iteration(spark):
    edges = some_edges(spark)
    seeds = spark.createDataFrame([(1, "v1", 1.0), (2, "v5", 0.5), (2, "v9", 1.5)], "query_id bigint, node_id string, score double")
    got = pagerank.forward_push(seeds, pagerank.transitions(edges), least=0.0, rounds=12).collect()
    plain = [tuple(r)[:2] + (r.weight,) for r in edges.collect()]
    for q, shares in ((1, {"v1": 1.0}), (2, {"v5": 0.25, "v9": 0.75})):
        want = {k: v for k, v in walk(plain, shares, 0.15, 12).items() if v > 0}
        mine = {r.node_id: r for r in got if r.query_id == q}
        assert {k: r.rank_mass for k, r in mine.items() if r.rank_mass > 0} == pytest.approx(want)
        assert max(r.score for r in mine.values()) == 1


def test_push_equals_the_bounded_search_on_small_neighbourhoods(spark):
    edges = some_edges(spark)
    seeds = spark.createDataFrame([(1, "v1", 1.0), (2, "v5", 0.5)], "query_id bigint, node_id string, score double")
    bounded = pagerank.personalised_pagerank(seeds, edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight")), iterations=15, hops=20)
    want = {(r.query_id, r.node_id): r.score for r in bounded.collect()}
    got = {(r.query_id, r.node_id): r.score for r in pagerank.forward_push(seeds, pagerank.transitions(edges), least=0.0, rounds=15).collect()}
    assert len(want) > 60 and got == pytest.approx(want)


@pytest.mark.parametrize("least", [1e-2, 1e-4])
def test_push_stays_within_its_bound(spark, least):
    edges = some_edges(spark, 300, 900)
    seeds = spark.createDataFrame([(1, "v1", 1.0)], "query_id bigint, node_id string, score double")
    got = pagerank.forward_push(seeds, pagerank.transitions(edges), least=least, rounds=300).collect()
    exact = walk([tuple(r)[:2] + (r.weight,) for r in edges.collect()], {"v1": 1.0}, 0.15, 400)
    mass = {r.node_id: r.rank_mass for r in got}
    assert sum(abs(mass.get(k, 0.0) - v) for k, v in exact.items()) <= 2 * got[0].residual + 1e-9
    assert sum(mass.values()) == pytest.approx(1)


def test_push_reads_all_links_only_for_nodes_that_have_not_pushed(spark, monkeypatch):
    """Once all nodes of a neighbourhood have pushed, rounds read the links that are kept and not the table."""
    edges = some_edges(spark, 12, 60)
    seeds = spark.createDataFrame([(1, "v1", 1.0), (2, "v5", 1.0)], "query_id bigint, node_id string, score double")
    links, plans, real = pagerank.transitions(edges), [], pagerank.cut

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(pagerank, "cut", noted)
    got = pagerank.forward_push(seeds, links, least=0.0, rounds=20).collect()
    assert len(plans) > 20 and 0 < sum("adjacency_" in p for p in plans) < 8
    exact = walk([tuple(r)[:2] + (r.weight,) for r in edges.collect()], {"v1": 1.0}, 0.15, 20)
    assert {r.node_id: r.rank_mass for r in got if r.query_id == 1} == pytest.approx({k: v for k, v in exact.items() if v > 0})


def test_push_of_odd_seeds(spark):
    edges = some_edges(spark)
    seeds = spark.createDataFrame([(1, "nowhere", 1.0), (2, "v1", 0.0), (2, "v2", 0.0), (3, "v1", 1.0), (3, "v1", 1.0)], "query_id bigint, node_id string, score double")
    got = {(r.query_id, r.node_id): (r.score, r.residual) for r in pagerank.forward_push(seeds, pagerank.transitions(edges), rounds=5).collect()}
    assert got[1, "nowhere"] == (1.0, 0.0) and {q for q, _ in got} == {1, 2, 3}
    assert pagerank.forward_push(seeds.limit(0), pagerank.transitions(edges)).count() == 0


def test_copies_of_names_and_texts_are_looked_up_once(spark):
    """Of nodes that look the same the first k are scored, and a text that many queries ask is looked up once; the rows are those of comparing all."""
    names = ["red ring", "blue ring", "red widget", "order 7"]
    nodes = spark.createDataFrame([(f"k{i:04d}", names[i % 4], "Part", "") for i in range(800)], "node_id string, name string, type string, about string")
    texts = spark.createDataFrame([(i, names[i % 3]) for i in range(30)], "query_id bigint, text string")
    index = NameIndex(nodes)
    given, _ = index._once(texts)
    types = index._types(given, by_term)
    assert given.count() == 3 and index._scored(index._compared(index.candidates(given, types, 5, 0.0, 4.5, [])[0]), types, 5, []).count() <= 3 * len(names) * 5
    assert rows(index.fuzzy(texts, 5)) == rows(graph.fuzzy_seeds(texts, nodes, 5))
    assert rows(index.keyword(texts, 5)) == rows(graph.keyword_seeds(texts, nodes, 5))


@pytest.mark.parametrize("k", [1, 4])
def test_keyword_candidates_grow_with_texts_alone(spark, k):
    """With all names different and terms in many of them, a text's candidates are a few for each set of its terms; the rows are those of scoring all."""
    rnd = random.Random(8)
    name = lambda i: f"{rnd.choice(WORDS)} {rnd.choice(WORDS)} {i}"
    nodes = spark.createDataFrame([(f"k{i:04d}", name(i), rnd.choice(["Part", "Red", None])) for i in range(1500)], "node_id string, name string, type string").cache()
    asked = nodes.where("node_id like '%0'").selectExpr("cast(substr(node_id, 2) as bigint) AS query_id", "name AS text")
    more = [(-1, "red"), (-2, "g"), (-3, " ".join([*WORDS, "17"])), (-4, "ed ring 1"), (-5, "none of these"), (-6, "12")]
    texts = asked.union(spark.createDataFrame(more, asked.schema))
    index = NameIndex(nodes)
    small = texts.withColumn("small", F.lower("text"))
    most = index._with_terms(small.where("query_id >= 0"), k).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert most <= 7 * 3 * k and index._holding(small, k).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * k
    assert rows(index.keyword(texts, k)) == rows(graph.keyword_seeds(texts, nodes, k))


def test_nearest_nodes_equal_a_cut_of_all(spark):
    """A bounded search keeps the same nodes as the whole one cut by hop and id, at any bound; edges of hubs are found by pairs."""
    rnd = random.Random(7)
    made = [(f"v{rnd.randrange(40)}", f"v{rnd.randrange(40)}", "E", rnd.choice([None, 1.0, 2.5])) for _ in range(120)] + [("v1", f"w{i:03d}", "E", 1.0) for i in range(300)]
    edges = spark.createDataFrame(made, "src string, dst string, type string, weight double")
    seeds = spark.createDataFrame([(i, f"v{i}", 1.0) for i in range(6)] + [(1, "v9", 1.0)], "query_id bigint, node_id string, score double")
    for most in (1, 5, 60):
        found = sorted(graph.breadth_first(seeds, edges, 3).collect(), key=lambda r: (r.query_id, r.hop_distance, r.node_id))
        want = {(r.query_id, r.node_id) for i, r in enumerate(found) if r.hop_distance == 0 or sum(x.query_id == r.query_id for x in found[:i]) < most}
        got = [tuple(r) for r in pagerank.nearest_nodes(seeds, edges, 3, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        inner = {}
        for s, d, _, w in made:
            for q in {q for q, n in want if n == s and (q, d) in want and s != d}:
                for x in ((q, s, d), (q, d, s)):
                    inner[x] = max(inner.get(x, 0.0), 1.0 if w is None else w)
        local = {(r.query_id, r.src, r.dst): r.weight for r in pagerank.local_graph(seeds, edges, 3, most).where("dst IS NOT NULL").collect()}
        assert local == inner


def test_a_bounded_search_lists_no_more_than_its_bound(spark):
    """Queries times the bound, not queries times the neighbours of a hub."""
    edges = spark.range(3000).select(F.lit("hub").alias("src"), F.format_string("w%05d", "id").alias("dst"), F.lit("E").alias("type"), F.lit(1.0).alias("weight"))
    seeds = spark.range(50).select(F.col("id").alias("query_id"), F.lit("hub").alias("node_id"), F.lit(1.0).alias("score"))
    assert pagerank.nearest_nodes(seeds, edges, 3, 20).count() == 50 * 20


def test_texts_of_passages_do_not_travel(spark):
    """What is asked of a passage is found before it is joined to visits, and no sort or exchange of visits holds texts."""
    edges = some_edges(spark)
    nodes = spark.createDataFrame([(f"v{i}", "T", f"name {i}", i if i % 2 else None) for i in range(60)], "node_id string, type string, name string, vec_id bigint")
    passages = spark.createDataFrame([(i, "text " * i) for i in range(0, 40)], "vec_id bigint, page_content string")
    seeds = spark.createDataFrame([(i, f"v{i}", 1.0) for i in range(5)], "query_id bigint, node_id string, score double")
    visited = graph.breadth_first(seeds, edges, 2)
    whole = graph.node_documents(visited, nodes, edges, passages)
    short = graph.node_documents(visited, nodes, edges, passages, of=F.md5)
    assert sorted(whole.withColumn("page_content", F.md5("page_content")).collect()) == sorted(short.collect())


def test_depth_first_over_a_large_hub(spark):
    """More neighbours than the default bound: whole if the bound is lifted, an error if not."""
    edges = spark.range(12_000).select(F.lit("hub").alias("src"), F.format_string("w%05d", "id").alias("dst"))
    seeds = spark.createDataFrame([(1, "hub", 1.0), (2, "w00001", 1.0)], "query_id bigint, node_id string, score double")
    found = graph.depth_first(seeds, edges, 2, most_nodes=None)
    assert found.count() == 12_002 and found.where("query_id = 1").orderBy("visit").limit(3).collect()[2].node_id == "w00001"
    with pytest.raises(ValueError):
        graph.depth_first(seeds, edges, 2)


def test_truth_by_classes_equals_listed_truth(spark):
    from tessera.operators import evaluate

    rnd = random.Random(5)
    items = spark.createDataFrame([(i, rnd.choice([0, 1, 2, None])) for i in range(60)] + [(60, 9)], "id bigint, class int")
    queries = items.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    results = spark.createDataFrame([(q, i, n) for q in range(0, 61, 5) for n, i in enumerate([q, *rnd.sample(range(61), 8)], 1)], "query_id bigint, id bigint, rank int").dropDuplicates(["query_id", "id"])
    truth = queries.join(items, "class").where("id <> query_id").select("query_id", "id")
    by_class = evaluate.per_query_of_classes(results, queries, items, 7)
    assert sorted(by_class.collect()) == sorted(evaluate.per_query(results, truth, 7).collect()) and by_class.count() > 5


def test_ranks_of_queries_are_found_in_several_tasks(spark):
    edges = some_edges(spark)
    seeds = spark.createDataFrame([(i, f"v{i}", 1.0) for i in range(40)], "query_id bigint, node_id string, score double")
    found = pagerank.personalised_pagerank(seeds, edges).withColumn("task", F.spark_partition_id())
    assert found.agg(F.countDistinct("task")).first()[0] > 1
