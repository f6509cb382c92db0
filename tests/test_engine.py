import pytest

from tessera.engine import Engine
from tessera.functions.settings import Settings, resolve


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), Settings(chunk_size=80, chunk_overlap=0, top_k=2, tolerance="1e-6"))
    docs = spark.createDataFrame([(1, "Alice Smith works for Acme Corp in the big city"), (2, "Acme Corp builds rockets with Bob Jones"), (3, "a quiet lake with blue water"), (4, "")], "doc_id bigint, text string")
    first = e.ingest(docs).first()
    assert (first.documents, first.chunks, first.failed, first.nodes) == (3, 3, 0, 3)
    again = e.ingest(docs.where("doc_id < 3")).first()
    assert again.chunks == 0
    return e


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "who works for the big city"), (2, "blue water lake"), (3, "zzz")], "query_id bigint, text string")


def test_modes(engine, questions):
    top = {r.query_id: r.page_content for r in engine.retrieve(questions, "vector").where("rank = 1").collect()}
    assert top[1].startswith("Alice") and top[2].startswith("a quiet")
    assert "Acme Corp builds" in " ".join(r.page_content for r in engine.retrieve(questions, "graph").where("query_id = 1").collect())
    assert engine.retrieve(questions, "pagerank").where("query_id = 1").count() == 2
    assert {r.retrieval_source for r in engine.retrieve(questions, "hybrid").where("query_id = 1").collect()} == {"vector", "graph"}
    with pytest.raises(ValueError, match="unknown mode"):
        engine.retrieve(questions, "other")


def test_answers(engine, questions):
    got = engine.answer(questions, lambda prompts: [p.rsplit(": ", 1)[1].upper() for p in prompts]).collect()
    assert {r.answer for r in got} == {"WHO WORKS FOR THE BIG CITY", "BLUE WATER LAKE", "ZZZ"}
    assert engine.stats().first().chunks == 3


def test_settings(monkeypatch):
    monkeypatch.setenv("SOME_NAME", "value")
    assert resolve("os.environ/SOME_NAME") == resolve("#SOME_NAME") == "value" and resolve("plain") == "plain"
    with pytest.raises(KeyError):
        resolve("#NOT_SET_AT_ALL")
    assert Settings.of({"tolerance": "1e-6", "top_k": "3"}).tolerance == 1e-6
    with pytest.raises(ValueError, match="unknown"):
        Settings.of({"what": 1})
    with pytest.raises(ValueError, match="alpha"):
        Settings(alpha=2)


def test_relations_from_a_generator(spark, tmp_path):
    def says(prompts):
        return ["Alice | WORKS_FOR | Acme Corp\nAcme corp | OWNS | Plant" if "Acme" in p else "nothing" for p in prompts]

    e = Engine(spark, str(tmp_path), Settings(chunk_size=80, chunk_overlap=0), generator=says, provider="openai", overrides={"openai": "relationship_extraction_openai"})
    assert "JSON" in e.template
    docs = spark.createDataFrame([(1, "Alice runs Acme Corp"), (2, "a quiet lake")], "doc_id bigint, text string")
    counted = e.ingest(docs).first()
    assert (counted.nodes, counted.edges, counted.unread) == (3, 2, 0)
    assert {(r.src, r.type, r.dst) for r in e.graph_store.edges().collect()} == {("alice", "WORKS_FOR", "acme corp"), ("acme corp", "OWNS", "plant")}
    more = e.ingest(spark.createDataFrame([(3, "Acme Corp again")], "doc_id bigint, text string")).first()
    assert (more.chunks, more.nodes, more.edges) == (1, 3, 2)
    assert {r.weight for r in e.graph_store.edges().collect()} == {2.0}

    def fails(prompts):
        raise ConnectionError("down")

    e.generator = fails
    broken = e.ingest(spark.createDataFrame([(4, "Bob Jones met Jane Doe")], "doc_id bigint, text string")).first()
    assert (broken.unread, broken.nodes) == (1, 5)


def test_fallbacks(spark, engine, questions):
    strategies = {(r.query_id, r.strategy) for r in engine.seeds(questions).collect()}
    assert (1, "vector") in strategies and {q for q, _ in strategies} == {1, 2, 3}
    fuzzy = Engine(spark, engine.path, Settings(seed_strategy="fuzzy", seeds=1))
    asked = spark.createDataFrame([(1, "acme")], "query_id bigint, text string")
    assert [(r.node_id, r.strategy) for r in fuzzy.seeds(asked).collect()] == [("acme corp", "fuzzy")]
    strict = Engine(spark, engine.path, Settings(chunk_size=80, chunk_overlap=0, top_k=2, min_score=1.1))
    got = strict.retrieve(questions, "pagerank").collect()
    assert {r.retrieval_source for r in got} == {"vector_fallback"} and {r.query_id for r in got} == {1, 2, 3}


def test_reranking_streams_and_waiting(engine, questions):
    import asyncio

    longest = engine.reranked(questions, lambda q, d: [len(x) / 100 for x in d], k=1, fetch=3)
    assert {r.page_content[:5] for r in longest.collect()} == {"Alice"}

    def fails(q, d):
        raise TimeoutError

    kept = engine.reranked(questions.where("query_id = 2"), fails, k=1).first()
    assert kept.page_content.startswith("a quiet")
    assert "".join(engine.stream_answer("blue water lake", lambda prompt: iter(prompt.split("Question: ")[1].split("\n")[0]))) == "blue water lake"
    assert asyncio.run(engine.later("retrieve", questions, "vector")).count() == 6
    s = engine.stats().first()
    assert (s.n_nodes, s.with_vector, s.indexed, s.orphans) == (3, 3, 3, 0)


def test_prompts_and_providers():
    from datetime import datetime

    from tessera.functions import prompts, providers
    from tessera.sources import stores

    assert len(prompts.names()) == 11 and "01 February 2024, 03:04:05" in prompts.get("context_chat", datetime(2024, 2, 1, 3, 4, 5))
    assert prompts.fill("{a} {b} {a}", a="{b}") == "{b} {b} {b}" and prompts.choose("OpenAI", {"openai": "x"}) == "x" and prompts.choose(None) == "relationship_extraction"
    with pytest.raises(ValueError, match="no prompt"):
        prompts.get("other")
    hashed = providers.EMBEDDERS.make("fake", dim=4)
    assert len(hashed(["a b"])[0]) == 4
    assert providers.EMBEDDERS.of({"default": "m", "models": {"m": {"provider": "hash", "dim": 8}}})(["a"])[0] == stores.hash_embedding("a", 8)
    assert providers.EMBEDDERS.make("text-embedding-3-small", client=lambda texts, **o: [[o["size"]]] * len(texts), size=1)(["x"]) == [[1]]
    with pytest.raises(ValueError, match="client"):
        providers.EMBEDDERS.make("org/model")
    with pytest.raises(ValueError, match="unknown embedder"):
        providers.EMBEDDERS.make("what")
    assert stores.VECTOR_STORES.factory("parquet") is stores.VectorStore and stores.VECTOR_STORES.factory("tessera.sources.stores.VectorStore") is stores.VectorStore
    assert providers.backend(stores.VectorStore(None, "x")) == "tessera" and providers.backend(object()) == "generic"


def test_list_of_readers(capsys):
    from tessera.__main__ import main

    assert main(["--list-loaders"]) == 0 and "docx" in capsys.readouterr().out.split()
    assert main([]) == 1
