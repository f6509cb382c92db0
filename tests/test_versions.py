"""Stores and graphs that grow by commits: what readers see, what a commit writes, and writers that break off."""

import os

import pytest
from pyspark.sql import functions as F
from tessera.engine import Engine
from tessera.functions.settings import Settings
from tessera.sources import stores
from tessera.sources.versions import Conflict, Versions


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "vec_id bigint")


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, page_content string")


def seen(store):
    return sorted(tuple(r) for r in store.scan().select("vec_id", "page_content").collect())


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_deletes_and_upserts(spark, tmp_path):
    store = stores.VectorStore(spark, f"file://{tmp_path}/v")
    assert not store.exists()
    store.add(frame(spark, [(i, f"a{i}") for i in range(5)]))
    store.delete(ids(spark, 1, 3, 77))
    assert seen(store) == [(0, "a0"), (2, "a2"), (4, "a4")]
    store.add(frame(spark, [(1, "again"), (9, "b")]))  # after the delete: stays
    store.upsert(frame(spark, [(2, "new"), (9, "c"), (10, "d")]))
    want = [(0, "a0"), (1, "again"), (2, "new"), (4, "a4"), (9, "c"), (10, "d")]
    assert seen(store) == want
    assert [r.vec_id for r in store.get(ids(spark, 2, 3)).collect()] == [2]
    assert sorted(r.vec_id for r in store.scan(since=2).collect()) == [1, 2, 9, 10]
    store.compact()
    assert seen(store) == want and len(store.log.manifest()["tables"]["rows"]) == 1 and not store.log.manifest()["tables"]["deletes"]
    assert store.log.vacuum() > 0 and seen(stores.VectorStore(spark, store.path)) == want
    store.delete(ids(spark, *range(20)))
    assert seen(store) == []


def test_a_delete_writes_ids_only(spark, tmp_path):
    store = stores.VectorStore(spark, f"file://{tmp_path}/v")
    store.add(frame(spark, [(i, "long text " * 500 + str(i)) for i in range(2000)]).coalesce(1))
    before = written(tmp_path)
    store.delete(ids(spark, 5, 6).coalesce(1))
    assert written(tmp_path) - before < 5000 and store.scan().count() == 1998


def test_other_columns_of_later_rows(spark, tmp_path):
    store = stores.VectorStore(spark, f"file://{tmp_path}/v")
    store.add(frame(spark, [(1, "a")]))
    store.add(spark.createDataFrame([(2, "b", 0.5)], "vec_id bigint, page_content string, extra double"))
    assert sorted((r.vec_id, r.extra) for r in store.scan().collect()) == [(1, None), (2, 0.5)]


@pytest.mark.parametrize("step", ["write", "manifest", "rename"])
def test_a_writer_that_breaks_off_is_never_seen(spark, tmp_path, monkeypatch, step):
    store = stores.VectorStore(spark, f"file://{tmp_path}/v")
    store.add(frame(spark, [(1, "a"), (2, "b")]))
    before, rows = seen(store), frame(spark, [(3, "c")])
    if step == "write":
        rows = rows.withColumn("page_content", F.when(F.raise_error(F.lit("lost")).isNull(), "x"))
    elif step == "manifest":
        monkeypatch.setattr(Versions, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    else:
        real = Versions._folder

        def folder(self, path):
            if path.endswith("000000002.json"):
                raise OSError("lost")
            return real(self, path)

        monkeypatch.setattr(Versions, "_folder", folder)
    for change in (lambda: store.upsert(rows), lambda: store.delete(ids(spark, 1)) if step != "write" else store.add(rows), store.compact if step != "write" else (lambda: store.add(rows))):
        with pytest.raises(Exception, match="lost"):
            change()
        assert seen(stores.VectorStore(spark, store.path)) == before
    monkeypatch.undo()
    store.upsert(frame(spark, [(2, "B")]))
    assert seen(store) == [(1, "a"), (2, "B")]


def test_of_two_writers_one_gives_way(spark, tmp_path, monkeypatch):
    one, two = (Versions(spark, f"file://{tmp_path}/t") for _ in range(2))
    one.commit({"rows": frame(spark, [(1, "a")])})
    at = two.version()
    monkeypatch.setattr(two, "version", lambda: at)
    one.commit({"rows": frame(spark, [(2, "b")])})
    with pytest.raises(Conflict):
        two.commit({"rows": frame(spark, [(3, "c")])})
    assert sorted(r.vec_id for r in one.read("rows").collect()) == [1, 2]


DOCS = [(1, "Alice Smith works for Acme Corp in the big city"), (2, "Acme Corp builds rockets with Bob Jones"), (3, "a quiet lake with blue water"), (4, "Jane Doe met Bob Jones and Alice Smith"), (5, "Acme Corp met Jane Doe")]


def graph_of(engine):
    return sorted(tuple(r) for r in engine.graph_store.nodes().select("node_id", "type", "name").collect()), sorted(tuple(r) for r in engine.graph_store.edges().select("src", "dst", "type", "weight").collect())


def test_growth_equals_a_rebuild_and_writes_what_is_new(spark, tmp_path, monkeypatch):
    from tessera import engine as module

    settings = Settings(chunk_size=80, chunk_overlap=0)
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    whole, grown = Engine(spark, f"file://{tmp_path}/whole", settings), Engine(spark, f"file://{tmp_path}/grown", settings)
    whole.ingest(docs)
    rows = []
    for some in ("doc_id < 3", "doc_id = 3", "doc_id > 3"):
        grown.ingest(docs.where(some))
        rows.append(sum(r["count"] for r in [{"count": grown.graph_store.log.read(t, grown.graph_store.log.version() - 1).count()} for t in ("nodes", "edges", "mentions")]))
    assert graph_of(grown) == graph_of(whole) and max(rows) <= 4 + 6 + 5 and rows[1] == 0
    monkeypatch.setattr(module, "COMPACT_AFTER", 2)
    grown.ingest(spark.createDataFrame([(6, "Carl Orff met Acme Corp")], "doc_id bigint, text string"))
    assert grown.graph_store.deltas() == 1
    whole.ingest(spark.createDataFrame([(6, "Carl Orff met Acme Corp")], "doc_id bigint, text string"))
    assert graph_of(grown) == graph_of(whole)
    said = {(r.name, r.start, r.context) for r in grown.graph_store.mentions(spark.createDataFrame([("bob jones",)], "node_id string")).collect()}
    assert said == {("Bob Jones", 30, "Acme Corp builds rockets with Bob Jones"), ("Bob Jones", 13, "Jane Doe met Bob Jones and Alice Smith")}


def test_growth_by_a_generator_equals_a_rebuild(spark, tmp_path):
    def says(prompts):
        return ["Alice | WORKS_FOR | Acme Corp\nAcme corp | OWNS | Plant" if "Acme" in p else "Bob Jones | KNOWS | Alice" for p in prompts]

    settings = Settings(chunk_size=80, chunk_overlap=0)
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    whole, grown = (Engine(spark, f"file://{tmp_path}/{n}", settings, generator=says) for n in ("whole", "grown"))
    whole.ingest(docs)
    for some in ("doc_id < 3", "doc_id >= 3"):
        grown.ingest(docs.where(some))
    assert graph_of(grown) == graph_of(whole) and ("acme corp", "plant", "OWNS", 3.0) in graph_of(grown)[1]
    plant = grown.graph_store.mentions(spark.createDataFrame([("plant",)], "node_id string")).collect()
    assert len(plant) == 3 and {(r.name, r.kind, r.start, r.context) for r in plant} == {("Plant", "ENTITY", None, "Acme corp OWNS Plant")}


def test_an_ingest_that_broke_off_is_caught_up_with(spark, tmp_path, monkeypatch):
    settings = Settings(chunk_size=80, chunk_overlap=0)
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    whole, broken = Engine(spark, f"file://{tmp_path}/whole", settings), Engine(spark, f"file://{tmp_path}/broken", settings)
    whole.ingest(docs)
    monkeypatch.setattr(Engine, "_grow_graph", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        broken.ingest(docs.where("doc_id < 4"))
    monkeypatch.undo()
    counted = broken.ingest(docs).first()
    assert (counted.documents, counted.chunks, counted.embedded, counted.failed, counted.unread) == (2, 2, 2, 0, 0)
    assert graph_of(broken) == graph_of(whole)


def test_entities_from_an_extractor_of_ones_own(spark, tmp_path):
    def acronyms(chunks):
        return chunks.select(F.col("vec_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("page_content", F.lit("[A-Z]{2,}"), F.lit(0))).alias("mention_index", "name"), F.lit("ACRONYM").alias("kind"))

    e = Engine(spark, f"file://{tmp_path}/e", Settings(chunk_size=80, chunk_overlap=0), extractor=acronyms)
    e.ingest(spark.createDataFrame([(1, "NASA and ESA met Bob Jones")], "doc_id bigint, text string"))
    assert graph_of(e) == ([("esa", "ACRONYM", "ESA"), ("nasa", "ACRONYM", "NASA")], [("esa", "nasa", "NEAR", 1.0), ("nasa", "esa", "NEAR", 1.0)])


def test_searches_through_an_index(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", Settings(chunk_size=80, chunk_overlap=0, top_k=3))
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    e.ingest(docs.where("doc_id <= 3"))
    asked = spark.createDataFrame([(1, "Acme Corp rockets"), (2, "blue lake")], "query_id bigint, text string")
    e.build_index(cells=2), e.build_index("cosine", 2)
    e.ingest(docs)
    modes = [("vector", None), ("vector", "mmr"), ("vector", "similarity_score_threshold")]
    through = [sorted(map(tuple, e.vector(asked, kind=k).collect())) for _, k in modes]
    assert not isinstance(e._searched(), type(docs))
    e._searched = lambda metric="l2": e._vectors()
    assert through == [sorted(map(tuple, e.vector(asked, kind=k).collect())) for _, k in modes] and through[0]
    del e._searched
    e.chunks_store.delete(e.chunks_store.scan().limit(1).select("vec_id"))
    assert isinstance(e._searched(), type(docs))


def test_when_an_index_is_built(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "Acme Corp rockets")], "query_id bigint, text string")
    made = lambda e: Versions(spark, f"{e.path}/index").version()
    of = lambda kind: Engine(spark, f"file://{tmp_path}/{kind}", Settings(chunk_size=80, chunk_overlap=0, index=kind))
    eager, lazy, none = (of(k) for k in ("eager", "lazy", "none"))
    for e in (eager, lazy, none):
        e.ingest(docs)
    assert (made(eager), made(lazy), made(none)) == (1, 0, 0)
    found = [sorted(map(tuple, e.vector(asked).collect())) for e in (eager, lazy, none)]
    assert found[0] == found[1] == found[2] and (made(eager), made(lazy), made(none)) == (1, 1, 0)
    lazy.chunks_store.delete(lazy.chunks_store.scan().where("doc_id = 2").select("vec_id"))
    assert all("rockets" not in r.page_content for r in lazy.vector(asked).collect()) and made(lazy) == 2
    with pytest.raises(ValueError, match="index is"):
        Settings(index="other")


def test_the_whole_graph_is_ranked_without_a_limit_of_nodes(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    e = Engine(spark, f"file://{tmp_path}/e", Settings(chunk_size=80, chunk_overlap=0, max_nodes=0, max_hops=5))
    e.ingest(docs)
    asked = spark.createDataFrame([(1, "Acme Corp rockets")], "query_id bigint, text string")
    assert e.retrieve(asked, "pagerank").count() > 0
