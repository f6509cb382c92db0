"""Small inputs with results worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, evaluate, extraction, fusion, graph, metrics, pagerank, rerank, vectors
from tessera.sources import registry, stores


def edges(spark, rows):
    return spark.createDataFrame([(s, d, "E", float(w)) for s, d, w in rows], "src string, dst string, type string, weight double")


def seeds(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, node_id string, score double")


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_bfs_decay_is_cumulative(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1)])
    found = graph.breadth_first(seeds(spark, [(1, "a", 1.0)]), e, 3)
    score = by(found, "node_id", "relevance_score")
    assert by(found, "node_id", "hop_distance") == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert np.allclose([score[x] for x in "abcd"], [1, 0.7, 0.343, 0.343 * 0.343])


def test_bfs_first_parent_wins(spark):
    e = edges(spark, [("a", "x", 1), ("b", "x", 1)])
    found = graph.breadth_first(seeds(spark, [(1, "a", 0.2), (1, "b", 0.9)]), e, 1)
    assert by(found, "node_id", "relevance_score")["x"] == pytest.approx(0.9 * 0.7)


def test_dfs_goes_deep_first(spark):
    e = edges(spark, [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)])
    found = graph.depth_first(seeds(spark, [(1, "a", 1.0)]), e, 2)
    assert by(found, "node_id", "hop_distance") == {"a": 0, "b": 1, "c": 2}
    assert by(found, "node_id", "relevance_score")["c"] == pytest.approx(0.49)


def test_incident_edges_are_limited(spark):
    e = edges(spark, [("hub", f"n{i}", 1) for i in range(9)])
    visited = spark.createDataFrame([(1, "hub")] + [(1, f"n{i}") for i in range(9)], "query_id bigint, node_id string")
    n = by(graph.incident(visited, e).groupBy("node_id").count(), "node_id", "count")
    assert n["hub"] == 5 and n["n3"] == 1


def test_node_documents_fall_back_to_text(spark):
    nodes = spark.createDataFrame([("a", "Person", "Alice", 1), ("b", "Organization", "Acme", None)], "node_id string, type string, name string, vec_id bigint")
    passages = spark.createDataFrame([(1, "the passage")], "vec_id bigint, page_content string")
    e = edges(spark, [("a", "b", 1)])
    visited = graph.breadth_first(seeds(spark, [(1, "a", 1.0)]), e, 1)
    d = by(graph.node_documents(visited, nodes, e, passages), "node_id", "page_content")
    assert d == {"a": "the passage", "b": "Organization: Acme\na E b"}


@pytest.mark.parametrize("rows, seed", [([("n1", "n2", 1), ("n2", "n3", 1)], "n1"), ([("n1", "n2", 10), ("n1", "n3", 1)], "n1"), ([("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], "a")])
def test_pagerank_agrees_with_dense_iteration(spark, rows, seed):
    got = by(pagerank.personalised_pagerank(seeds(spark, [(1, seed, 1.0)]), edges(spark, rows)), "node_id", "score")
    names = sorted({x for r in rows for x in r[:2]})
    w = np.zeros((len(names),) * 2)
    for s, d, x in rows:
        w[names.index(s), names.index(d)] = w[names.index(d), names.index(s)] = x
    p = (w / w.sum(1, keepdims=True)).T
    t = np.array([float(n == seed) for n in names])
    x = t
    for _ in range(50):
        x = 0.15 * t + 0.85 * p @ x
    assert np.allclose([got[n] for n in names], x / x.max())


def test_heavier_edge_ranks_higher(spark):
    got = by(pagerank.personalised_pagerank(seeds(spark, [(1, "n1", 1.0)]), edges(spark, [("n1", "n2", 10), ("n1", "n3", 1)])), "node_id", "score")
    assert got["n2"] > got["n3"]


def test_local_graph_keeps_bounds_and_lone_seeds(spark):
    chain = edges(spark, [(f"n{i:03}", f"n{i + 1:03}", 1) for i in range(100)])
    local = pagerank.local_graph(seeds(spark, [(1, "n000", 1.0), (1, "alone", 1.0)]), chain, hops=3, most_nodes=3)
    assert {r.src for r in local.collect()} == {"n000", "n001", "alone"}


def test_best_vectors_dedups_and_ignores_case(spark):
    ranks = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.7), (1, "d", 0.1)], "query_id bigint, node_id string, score double")
    nodes = spark.createDataFrame([("a", "Entity", 1), ("b", "ENTITY", 1), ("c", "event", 2), ("d", "entity", 3)], "node_id string, type string, vec_id bigint")
    assert [(r.rank, r.vec_id) for r in pagerank.best_vectors(ranks, nodes, 5, 0.5, ["entity"]).collect()] == [(1, 1)]


@pytest.fixture
def lists(spark):
    v = spark.createDataFrame([(1, 1, "A", 1), (2, 1, "B", 2)], "id bigint, query_id bigint, page_content string, rank int")
    g = spark.createDataFrame([(3, 1, "C", 1, 1.0, 0.9), (4, 1, "A", 2, 2.0, 0.5)], "id bigint, query_id bigint, page_content string, rank int, hop_distance double, relevance_score double")
    return v, g


def order(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_fusion_modes(lists):
    assert order(fusion.combine(*lists, "concat")) == [1, 2, 3, 4]
    reranked = fusion.combine(*lists, "rerank")
    assert order(reranked) == [1, 2, 3, 4]
    assert by(reranked, "id", "score")[3] == pytest.approx(0.6 * 0.7 * 0.9)
    assert order(fusion.combine(*lists, "weighted", 0.5, 0.5)) == [1, 3, 2, 4]
    assert order(fusion.combine(*lists, "weighted", 0.3, 0.7)) == [1, 3, 4]
    assert by(fusion.combine(*lists, "expand"), "id", "role") == {1: "core", 2: "core", 3: "context", 4: "context"}
    assert order(fusion.first_of_content(fusion.combine(*lists, "concat"))) == [1, 2, 3]
    with pytest.raises(ValueError, match="unknown mode"):
        fusion.combine(*lists, "other")


def test_context_is_cut_once(spark):
    d = spark.createDataFrame([(1, 1, "x" * 100), (1, 2, "y" * 100)], "query_id bigint, rank int, page_content string")
    (row,) = fusion.format_context(d, 50).collect()
    assert row.context == "[1] " + "x" * 46 + "..."
    assert fusion.format_context(d).first().context == "[1] " + "x" * 100 + "\n\n[2] " + "y" * 100


def test_scores_are_parsed(spark):
    d = spark.createDataFrame([("8", 0.8), ("Score: 7", 0.7), ("The relevance is 6/10", 0.6), ("9.5", 0.95), ("Relevance: 5.5 out of 10", 0.55), ("none", 0.5), ("42", 1.0), (None, 0.5)], "a string, want double")
    assert all(r.got == pytest.approx(r.want) for r in d.select("want", rerank.parse_score(F.col("a")).alias("got")).collect())


def test_rerank_skips_short_lists_and_filters(spark):
    d = spark.createDataFrame([(1, i, f"d{i}", s) for i, s in enumerate([0.1, 0.9, 0.5], 1)], "query_id bigint, rank int, id string, s double")
    assert [r.id for r in rerank.rerank(d, F.col("s"), 5).orderBy("new_rank").collect()] == ["d1", "d2", "d3"]
    assert [r.id for r in rerank.rerank(d, F.col("s"), 2).orderBy("new_rank").collect()] == ["d2", "d3"]
    assert [r.id for r in rerank.rerank(d, F.col("s"), 5, 0.6).collect()] == ["d2"]
    answered = rerank.ask(d.selectExpr("query_id", "'q' AS text", "id AS page_content"), lambda ps: [str(len(p)) for p in ps], "{query}:{document}")
    assert {r.answer for r in answered.collect()} == {"4"}


def test_nearest_and_mmr(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(60, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)] + [(99, [1.0, 2.0])], "vec_id bigint, embedding array<float>").repartition(3)
    q = v.where("vec_id < 3").selectExpr("vec_id AS query_id", "embedding")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest(q, v, 5).collect()}
    for i in range(3):
        d = ((e.astype(float) - e[i].astype(float)) ** 2).sum(1)
        assert [got[i, k] for k in range(1, 6)] == np.lexsort((np.arange(60), d))[:5].tolist()
    picked = vectors.mmr(q, v, 4).where("query_id = 1").orderBy("rank").collect()
    unit = e.astype(float) / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    pool = np.argsort(-unit @ unit[1])[:8].tolist()
    chosen = []
    while len(chosen) < 4:
        chosen.append(max((i for i in pool if i not in chosen), key=lambda i: 0.5 * unit[i] @ unit[1] - 0.5 * max((unit[i] @ unit[j] for j in chosen), default=0.0)))
    assert [r.vec_id for r in picked] == chosen


def test_partial_ratio():
    assert graph.partial_ratio("abc", "xxabcxx") == 100.0
    assert graph.partial_ratio("abcd", "abxd") == 75.0
    assert graph.partial_ratio("", "") == 100.0 and graph.partial_ratio("", "a") == 0.0


def test_splitters():
    assert chunking.Options(size=100, overlap=150).overlap == 25
    assert chunking.Options("what").kind == "recursive"
    text = "Paragraph one.\n\nParagraph two."
    assert chunking.chunk_one(text, chunking.Options("character", 20, 5)) == ["Paragraph one.", "Paragraph two."]
    assert chunking.chunk_one("# A\none\n## B\ntwo", chunking.Options("header")) == ["# A\none", "## B\ntwo"]
    parts = chunking.chunk_one("word " * 200, chunking.Options("recursive", 60, 20))
    assert all(len(p) <= 60 for p in parts) and len(parts) > 15
    assert chunking.chunk_one("a" * 25, chunking.Options("recursive", 10, 0)) == ["a" * 10, "a" * 10, "a" * 5]
    assert chunking.chunk_one("", chunking.Options()) == [] and chunking.chunk_one("x", chunking.Options("none")) == ["x"]
    assert chunking.split_tokens("a b c d e", 2, 1) == ["a b", "b c", "c d", "d e"]


def test_relations(spark):
    texts = [
        ('```json\n{"relationships": [{"subject": "A", "relationship": "R", "object": "B"}]}\n```', [("A", "R", "B")]),
        ("| Subject | Relationship | Object |\n|---|---|---|\n| Alice | knows | Bob |\n| Bob | leads | Team |\n| short |", [("Alice", "knows", "Bob"), ("Bob", "leads", "Team")]),
        ("- Alice | founded | Acme\n- Bob -mentors-> Carol", [("Alice", "founded", "Acme"), ("Bob", "mentors", "Carol")]),
        ("Dana - reports to -> Erin", [("Dana", "reports to", "Erin")]),
        ("nothing", []),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "id int, text string")
    for r in d.select("id", extraction.parse_relations(F.col("text")).alias("t")).collect():
        assert [tuple(x) for x in r.t] == texts[r.id][1]
    terms = spark.createDataFrame([('["x", "y", "x"]',), ('1. "one"\n- two\n- one\n',)], "t string").select(extraction.parse_terms(F.col("t"), 2).alias("t")).collect()
    assert [r.t for r in terms] == [["x", "y"], ["one", "two"]]


def test_evaluation(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "d", 2)], "query_id bigint, id string, rank int")
    truth = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (3, "z")], "query_id bigint, id string")
    s = evaluate.per_query(results, truth, 2)
    assert {(r.query_id, r.recall, r.reciprocal_rank, r.perfect) for r in s.collect()} == {(1, 1.0, 0.5, True), (2, 1.0, 1.0, True), (3, 0.0, 0.0, False)}
    r = evaluate.summary(s).first()
    assert (r.n, r.mrr) == (3, 0.5)
    t = evaluate.latency(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "ms double"), "ms").first()
    assert (t.median, t.p95, t["std"]) == (2.5, pytest.approx(np.percentile([1, 2, 3, 4], 95)), pytest.approx(np.std([1, 2, 3, 4])))


def test_sessions(spark):
    rows = [(1, True, 5, 1024, 10, "2024-01-01 00:00:00"), (1, False, 0, 0, 5, "2024-01-01 00:00:01"), (2, True, 1, 1, 1, "2024-01-02 00:00:00")]
    d = spark.createDataFrame(rows, "session_id int, success boolean, document_count int, bytes int, processing_time_ms int, at string").withColumn("at", F.col("at").cast("timestamp"))
    one = {r.session_id: r for r in metrics.sessions(d).collect()}[1]
    assert (one.success_rate, one.documents, one.bytes, one.duration_us) == (0.5, 5, 1024, 1_000_000)
    assert [r.session_id for r in metrics.recent(metrics.sessions(d), 1).collect()] == [2]


def test_sources(spark, tmp_path):
    urls = [("https://arxiv.org/abs/1", "arxiv"), ("https://a.b/c", "website"), ("https://a.b/file.PDF?x=1", ".pdf"), ("/tmp/x.txt", ".txt"), ("http://a.com", "website")]
    d = spark.createDataFrame(urls, "url string, want string")
    extension, is_file = registry.classify(F.col("url"))
    assert all(r.got == r.want and r.file == (r.url[0] == "/") for r in d.select("url", "want", extension.alias("got"), is_file.alias("file")).collect())
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "b.html").write_text("<title>T</title><script>x</script><p>One &amp; two</p>")
    (tmp_path / "c.csv").write_text("k,v\n1,2\n3,4\n")
    got = registry.load(spark, [str(tmp_path / n) for n in ("a.txt", "b.html", "c.csv")])
    assert sorted(r.page_content for r in got.collect()) == ["T\nOne & two", "hello\nworld", "k: 1\nv: 2", "k: 3\nv: 4"]
    with pytest.raises(ValueError, match="no reader"):
        registry.get("odd")
    with pytest.raises(ValueError, match="no sources"):
        registry.load(spark, [])
    assert "txt" in registry.known() and registry.get(".TXT") is registry.get("txt")


def test_stores(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e")], "vec_id bigint, page_content string")
    embedded = stores.embed(chunks)
    store = stores.VectorStore(spark, str(tmp_path / "v"))
    store.add(embedded)
    ids = spark.createDataFrame([(1,), (9,)], "vec_id bigint")
    assert [r.vec_id for r in store.get(ids, 64).collect()] == [1] and store.get(ids, 3).isEmpty()
    assert sorted(r.vec_id for r in store.delete(ids, str(tmp_path / "w")).scan().collect()) == [2, 3]

    def broken(texts):
        raise ConnectionError("down")

    assert {(r.error, r.embedding) for r in stores.embed(chunks, broken).collect()} == {("down", None)}
    g = stores.GraphStore(spark, str(tmp_path / "g"), "json")
    nodes = spark.createDataFrame([("a", None, None, 1)], "node_id string, type string, name string, vec_id bigint")
    g.save(nodes, spark.createDataFrame([("a", "b", None, None)], "src string, dst string, type string, weight double"))
    assert g.nodes().first().asDict() == {"node_id": "a", "type": "Entity", "name": "a", "vec_id": 1}
    assert tuple(g.edges().first()) == ("a", "b", "RELATED_TO", 1.0)
    assert g.sql("SELECT count(*) AS n FROM nodes").first().n == 1


def test_cache(spark):
    c = spark.createDataFrame([("web", "u", "2024-01-01 00:00:00", 1), ("web", "u", "2024-01-01 00:00:05", 2), ("web", "v", "2023-01-01 00:00:00", 3)], "source_type string, identifier string, at string, entry_id int").withColumn("cached_at", F.col("at").cast("timestamp"))
    now = F.lit("2024-01-01 00:00:10").cast("timestamp")
    assert [r.entry_id for r in stores.cache_valid(c, now, 60).collect()] == [2]
    assert sorted(r.entry_id for r in stores.cache_valid(c, now, 0).collect()) == [2, 3]
    assert stores.cache_clear(c, "web", "u").count() == 1 and stores.cache_clear(c).count() == 0


def test_entities(spark):
    d = spark.createDataFrame([(1, "Acme Corp met Jane Doe and Acme  Corp"), (2, "Jane Doe left")], "doc_id bigint, text string")
    found = extraction.mentions(d)
    nodes = {r.key: (r.n_mentions, r.n_docs) for r in extraction.entities(found).collect()}
    assert nodes == {"acme corp": (1, 1), "jane doe": (2, 2)}
    assert [(r.src, r.dst, r.weight) for r in extraction.cooccurrence(found).collect()] == [("acme corp", "jane doe", 1)]
    assert spark.createDataFrame([(" works  for!",)], "n string").select(extraction.normal_relation(F.col("n"))).first()[0] == "WORKS_FOR"


def test_fuzzy_seed_nodes_scores_all_nodes(spark, monkeypatch):
    """The registered query against a plain partial ratio over every node."""
    from tessera.plans import graph_queries, graphs

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
        return out

    def ratio(a, b):
        a, b = sorted((a, b), key=len)
        return max(100.0 * common(a, b[i : i + len(a)]) / len(a) for i in range(len(b) - len(a) + 1))

    folder, scored = "/root/testdata/sf0.001", []
    search = graph.fuzzy_seeds
    monkeypatch.setattr(graph, "fuzzy_seeds", lambda queries, nodes, k: scored.append(nodes.count()) or search(queries, nodes, k))
    got = {(r.query_id, r.rank): (r.node_id, r.score) for r in graph_queries.fuzzy_seed_nodes(spark, folder).collect()}
    nodes = graphs.nodes(spark, folder).collect()
    assert scored == [len(nodes)]
    for q, text in ((1, "asia"), (2, "nation")):
        best = sorted((-min(1.0, (ratio(text, n.name.lower()) * 0.03 + ratio(text, n.type.lower()) * 0.01) / 4.5), n.node_id) for n in nodes)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, round(-s, 6)) for s, i in best]


def test_neighbours_of_equal_vectors_go_by_id(spark):
    """More equal (and nearly equal, large) vectors than any shortlist holds."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(10_000 + i, [1e6 + i % 3, 1e6, 1e6]) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.5]), (2, [1e6, 1e6, 1e6])], "query_id bigint, embedding array<double>")
    for metric in ("l2", "cosine"):
        got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest(q, v, 8, metric).collect()}
        assert [got[1, k] for k in range(1, 9)] == list(range(8))
    assert [r.vec_id for r in vectors.nearest(q.where("query_id = 2"), v, 5).orderBy("rank").collect()] == [10_000 + 3 * i for i in range(5)]


def test_queries_beyond_the_limit_go_in_groups(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id bigint, embedding array<double>")
    q = v.selectExpr("vec_id AS query_id", "embedding")
    monkeypatch.setattr(vectors, "MOST_QUERIES", 7)
    got = vectors.nearest(q, v, 1).collect()
    assert len(got) == 50 and all(r.query_id == r.vec_id for r in got)
    nodes = spark.createDataFrame([(f"n{i}", f"name {i}", "T") for i in range(9)], "node_id string, name string, type string")
    asked = spark.createDataFrame([(i, f"name {i}") for i in range(9)], "query_id bigint, text string")
    monkeypatch.setattr(graph, "MOST_TEXTS", 2)
    assert {(r.query_id, r.node_id) for r in graph.keyword_seeds(asked, nodes, 1).collect()} == {(i, f"n{i}") for i in range(9)}
    assert {(r.query_id, r.node_id) for r in graph.fuzzy_seeds(asked, nodes, 1).collect()} == {(i, f"n{i}") for i in range(9)}


def test_kinds_of_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, None)], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.3])], "query_id bigint, embedding array<double>")
    ids = lambda kind, **o: [r.vec_id for r in vectors.search(q, v, 2, kind, **o).orderBy("rank").collect()]
    assert ids("similarity") == ids("unheard of") == [3, 1] and ids("mmr", fetch_k=3) == [3, 2] and ids("similarity_score_threshold", least=0.97) == [3]
    assert {(r.dim, r.n_vectors) for r in vectors.stats(v).collect()} == {(2, 3), (None, 1)}


def test_properties_count_in_scores_and_texts(spark):
    nodes = spark.createDataFrame([("a", "Alpha", "Person", "likes red boats", None, 1), ("b", "Beta", "Person", None, "x", 2)], "node_id string, name string, type string, about string, chunk_id string, vec_id bigint")
    assert graph.text_properties(nodes) == ["about"]
    asked = spark.createDataFrame([(1, "red boats")], "query_id bigint, text string")
    (r,) = graph.keyword_seeds(asked, nodes, 2, properties=["about"]).collect()
    assert (r.node_id, r.score) == ("a", 0.5)
    plain, rich = (by(graph.fuzzy_seeds(asked, nodes, 2, properties=p), "node_id", "score") for p in (None, ["about"]))
    assert rich["a"] == pytest.approx(plain["a"] + 0.5 / 4.5) and rich["b"] == plain["b"]
    visited = spark.createDataFrame([(1, "a", 0, 1.0)], "query_id bigint, node_id string, hop_distance int, relevance_score double")
    none = spark.createDataFrame([], "vec_id bigint, page_content string")
    d = graph.node_documents(visited, nodes, edges(spark, [("a", "a", 1)]), none, properties=["about"]).first()
    assert d.page_content == "Person: Alpha\n  about: likes red boats\na E a"


def test_pagerank_seeds(spark):
    nodes = spark.createDataFrame([("a", "alice", "Person", 1), ("b", "bob", "City", 1), ("c", "carol", None, 2)], "node_id string, name string, type string, vec_id bigint")
    asked = spark.createDataFrame([(1, "alice city")], "query_id bigint, text string")
    got = by(pagerank.keyword_seeds(asked, nodes, 5, 1.0), "node_id", "score")
    want = {n: graph.partial_ratio("alice city", n) * 0.03 + (0.1 if t == "City" else 0) for n, t in (("alice", "Person"), ("bob", "City"), ("carol", None))}
    assert got == {n[0]: pytest.approx(min(1, s / 4.5)) for n, s in want.items() if s >= 1.0}
    chunks = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 1, 0.1), (1, 3, 2, None)], "query_id bigint, rank int, vec_id bigint, score double")
    assert {(r.node_id, r.score) for r in pagerank.chunk_seeds(chunks, nodes).collect()} == {("a", 0.9), ("b", 0.9), ("c", 0.5)}


def test_lenient_json(spark):
    texts = ["Sure! {relationships: [{'subject': 'A', 'relationship': 'R', 'object': 'B',},]} done", '{"subject": "A", "relationship": "R", "object": "B"}', '```JSON\n[\n{"subject": "A", "relationship": "R", "object": "B"},\n]\n```', "[]", "no { json"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", extraction.parse_json(F.col("text")).alias("t"))
    assert {r.id: [tuple(x) for x in r.t] for r in d.collect()} == {0: [("A", "R", "B")], 1: [("A", "R", "B")], 2: [("A", "R", "B")], 3: [], 4: []}
    own = lambda text: F.array(F.struct(F.lit("s").alias("subject"), F.lit("r").alias("relationship"), F.lit("o").alias("object")))
    assert spark.createDataFrame([("a | b | c",)], "t string").select(extraction.parse_relations(F.col("t"), custom=own)[0]["subject"]).first()[0] == "s"


def test_known_nodes_are_linked_and_others_made(spark):
    triples = spark.createDataFrame([(1, 0, "Alice", "KNOWS", "Bob"), (2, 0, " alice ", "KNOWS", "bob"), (2, 1, "Bob", "LEADS", "Team")], "vec_id bigint, pos int, subject string, relationship string, object string")
    known = spark.createDataFrame([("n7", "ALICE"), ("n9", "alice")], "node_id string, name string")
    nodes, found = extraction.ensure_nodes(triples, known)
    assert {(r.node_id, r.mentions, r.created) for r in nodes.collect()} == {("n7", 2, False), ("bob", 3, True), ("team", 1, True)}
    assert {(r.src, r.type, r.dst, r.vec_id, r.mentions) for r in found.collect()} == {("n7", "KNOWS", "bob", 1, 2), ("bob", "LEADS", "team", 2, 1)}


def test_graph_databases_pickles_and_removal(spark, tmp_path):
    import json

    class Database:
        """A graph database in a folder, as tasks see it."""

        def __init__(self, folder):
            self.folder = folder

        def wipe(self):
            for f in self.folder.glob("*"):
                f.unlink()

        def _put(self, kind, rows, *key):
            import json
            import uuid

            (self.folder / f"{kind}-{uuid.uuid4().hex}").write_text(json.dumps([[[r[k] for k in key], r] for r in rows]))

        def merge_nodes(self, rows):
            self._put("nodes", rows, "node_id")

        def merge_edges(self, rows):
            self._put("edges", rows, "src", "dst", "type")

    nodes = spark.createDataFrame([("a", "T", "old", 1), ("a", "T", "z new", 1), ("b", "T", "b", None)], "node_id string, type string, name string, vec_id bigint")
    e = edges(spark, [("a", "b", 1), ("a", "b", 2)])
    folder = tmp_path / "db"
    folder.mkdir()
    (folder / "junk").write_text("")
    stores.send(nodes, e, lambda: Database(folder), wipe=True, batch=1)
    read = lambda kind: sorted(tuple(k) + (r.get("name", r.get("weight")),) for f in folder.glob(f"{kind}-*") for k, r in json.loads(f.read_text()))
    assert read("nodes") == [("a", "z new"), ("b", "b")] and read("edges") == [("a", "b", "E", 2.0)] and not (folder / "junk").exists()
    g = stores.GraphStore(spark, str(tmp_path / "p"), "pickle")
    g.save(nodes, e)
    assert g.nodes().count() == 3 and g.edges().agg(F.sum("weight")).first()[0] == 3.0 and graph.contains(g.nodes(), "b") and graph.edge_data(g.edges(), "a", "b").count() == 2
    v = stores.VectorStore(spark, str(tmp_path / "v"))
    v.add(spark.createDataFrame([(1, "x"), (2, "y")], "vec_id bigint, page_content string"))
    v.remove(spark.createDataFrame([(1,)], "vec_id bigint"))
    assert [r.vec_id for r in v.scan().collect()] == [2]


def test_manifests(spark, tmp_path):
    from tessera.sources.manifests import Manifest

    m, kind = Manifest(spark, str(tmp_path)), "name string, size bigint"
    assert m.get("staged", kind).count() == 0
    m.put("staged", spark.createDataFrame([("a", 1), ("b", None)], kind))
    m.put("loaded", spark.createDataFrame([("c", 3)], kind))
    assert {tuple(r) for r in Manifest(spark, str(tmp_path)).get("staged", kind).collect()} == {("a", 1), ("b", None)}
    m.clear("staged")
    assert m.get("staged", kind).count() == 0 and m.get("loaded", kind).count() == 1
    with pytest.raises(ValueError, match="unknown state"):
        m.put("other", m.get("loaded", kind))


@pytest.mark.parametrize("parts", [1, 7])
def test_pages_of_a_source_stand_where_the_joined_text_has_them(spark, parts):
    """A source with most pages, cut over ranges, against joining in plain Python."""
    rnd = np.random.default_rng(5)
    rows = [("hot" if i % 3 else "cold" if i % 2 else None, int(rnd.integers(0, 40)), "x" * int(rnd.integers(0, 9)) + chr(97 + i % 26)) for i in range(200)] + [("short", 1, ""), ("short", 2, None)]
    d = spark.createDataFrame(rows, "source string, page int, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        pages = metrics.pages_of_sources(d)
        got, about = pages.collect(), {r.source: r for r in metrics.by_source(pages, preview=50).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    for source in ("hot", "cold", None, "short"):
        own = sorted((p, t or "") for s, p, t in rows if s == source)
        whole = "\n\f\n".join(t for _, t in own)
        mine = sorted((r for r in got if r.source == source), key=lambda r: r.place)
        assert [(r.page, r.text) for r in mine] == own and all(whole[r.start : r.start + len(r.text)] == r.text for r in mine)
        r = about[source]
        assert (r.n_pages, r.n_chars, r.preview) == (len(own), len(whole), whole[:50])


def test_latency_in_a_sketch(spark):
    d = spark.range(1, 1001).select(F.col("id").cast("double").alias("ms"))
    t = evaluate.latency(d, "ms", accuracy=1000).first()
    assert abs(t.median - 500) <= 2 and abs(t.p99 - 990) <= 2 and t.n == 1000


def test_windows_of_a_models_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = Tokenizer.from_file(path).encode
    text = "The quick brown fox, jumps over  the lazy dog! naïve 中文😀 text " * 40
    whole = chunking.split_model_tokens(text, 50, 0, path)
    assert "".join(whole).replace(" ", "") == text.replace(" ", "") and len(whole) == -(-len(encode(text.strip()).ids) // 50)
    assert all(len(encode(c).ids) <= 53 for c in whole)
    overlapping = chunking.split_model_tokens(text, 50, 10, path)
    assert len(overlapping) > len(whole) and all(a[-12:].strip()[-6:] in b for a, b in zip(overlapping, overlapping[1:], strict=False))
    assert chunking.split_model_tokens("", 5, 0, path) == chunking.split_model_tokens("  ", 5, 0, path) == [] and chunking.split_model_tokens("a<|endoftext|>b", 50, 0, path) == ["a<|endoftext|>b"]
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    got = [r.page_content for r in chunking.chunk(docs, chunking.Options("token", 50, 0, path)).orderBy("doc_id", "chunk_index").collect()]
    assert got == whole
