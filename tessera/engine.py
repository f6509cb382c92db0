"""Ingest documents, then answer batches of questions by any retriever. All state is tables under one path."""

from __future__ import annotations

import asyncio
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions import prompts
from tessera.functions.settings import MODES, Settings
from tessera.operators import chunking, extraction, fusion, graph, pagerank, rerank, vectors
from tessera.operators.name_index import NameIndex, by_term
from tessera.operators.vector_index import VectorIndex
from tessera.sources import registry, stores
from tessera.sources.tables import cut
from tessera.sources.versions import Versions

Embedder = Callable[[list[str]], list[list[float] | None]]
Generator = Callable[[list[str]], list[str]]
#: Mentions of entities in chunks: (vec_id, doc_id, page_content) -> doc_id (the vec_id of the chunk), mention_index, name and, if known, kind, start, end, context.
Extractor = Callable[[DataFrame], DataFrame]
#: Commits of the graph after which it is compacted.
COMPACT_AFTER = 16


class Engine:
    """path holds chunks (with vectors and the number of the ingest that brought them) and versions of the graph.

    embedder: texts to vectors; a hashing one by default. generator: prompts to answers, for relations between entities (none: names that stand side by side are
    related), with the prompt that overrides name for its provider, and a parser of its answers if the common forms do not do. extractor: finds entities, in place of names by their capitals."""

    def __init__(
        self, spark: SparkSession, path: str, settings: Settings | None = None, embedder: Embedder | None = None, generator: Generator | None = None, provider: str | None = None,
        overrides: dict[str, str] | None = None, parser: Callable[[Column], Column] | None = None, extractor: Extractor | None = None,
    ):
        self.spark, self.path, self.settings, self.embedder = spark, path, settings or Settings(), embedder
        self.generator, self.parser = generator, parser
        self.extractor = extractor or (lambda chunks: extraction.mentions_in_context(chunks, "vec_id", "page_content"))
        self.template = prompts.get(prompts.choose(provider, overrides))
        self.chunks_store = stores.VectorStore(spark, f"{path}/chunks")

    @property
    def graph_store(self) -> stores.GraphLog:
        return stores.GraphLog(self.spark, f"{self.path}/graph")

    def ingest(self, docs: DataFrame) -> DataFrame:
        """docs: doc_id and page_content or text. Chunks that the store has are not added again, and the graph grows by what new chunks say; both are written as what is new, whatever there was before. An ingest that
        broke off is caught up with by the next one. Returns one row of counters: of chunks as the writing jobs saw them (a task that is run again after its stage ended counts twice), of the graph as it is when they are read."""
        s = self.settings
        options = chunking.Options(s.chunk_kind, s.chunk_size, s.chunk_overlap)
        given = registry.as_documents(docs).where(F.length("page_content") > 0)
        found = chunking.chunk(given, options, "doc_id", "page_content").withColumn("vec_id", F.xxhash64("chunk_id")).dropDuplicates(["vec_id"])
        number = self.chunks_store.log.version() + 1
        if self.chunks_store.exists():
            found = found.join(self.chunks_store.scan().select("vec_id"), "vec_id", "left_anti")
        seen = Observation()
        embedded = stores.embed(found, self.embedder, s.dim).withColumn("ingest", F.lit(number).cast("long"))
        self.chunks_store.add(embedded.observe(seen, F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded"), F.count("error").alias("failed")))
        unread = self._grow_graph()
        if s.index == "eager":
            self.build_index()
        of = {k: F.lit(v).cast("long").alias(k) for k, v in {**seen.get, "unread": unread}.items()}
        documents = self.chunks_store.scan(number - 1).agg(F.countDistinct("doc_id").alias("documents"))
        store = self.graph_store
        nodes, edges = (t.agg(F.count("*").alias(n)) for t, n in ((store.nodes(), "nodes"), (store.edges(), "edges")))
        return documents.join(nodes).join(edges).select("documents", of["chunks"], of["embedded"], of["failed"], "nodes", "edges", of["unread"])

    def _grow_graph(self) -> int:
        """Adds what chunks say that came after the last growth. Returns chunks of which the generator could not be asked."""
        store, unread = self.graph_store, 0
        upto = self.chunks_store.log.version()
        new = self.chunks_store.scan(store.log.manifest()["note"].get("chunks", 0))
        found = self.extractor(new.select("vec_id", "doc_id", "page_content"))
        for name, default in (("kind", F.lit("ENTITY")), ("start", F.lit(None).cast("int")), ("end", F.lit(None).cast("int")), ("context", F.lit(None).cast("string"))):
            found = found.withColumn(name, F.coalesce(F.col(name), default) if name in found.columns else default)
        found = cut(found)
        said = found.select(extraction.canonical(F.col("name")).alias("node_id"), F.col("doc_id").alias("vec_id"), "mention_index", "name", "kind", "start", "end", "context")
        named = found.groupBy(extraction.canonical(F.col("name")).alias("node_id")).agg(F.min("kind").alias("type"), F.min("name").alias("name"), F.min("doc_id").alias("vec_id"))
        if self.generator:
            asked = Observation()
            answers = extraction.ask_each(new.select("vec_id", "page_content"), self.generator, self.template)
            answered = cut(answers.observe(asked, F.count("error").alias("unread")))
            unread = asked.get["unread"]
            triples = extraction.relations(answered, custom=self.parser)
            ends, pairs = extraction.ensure_nodes(triples, named)
            named = named.unionByName(ends.where("created").select("node_id", "type", "name", "vec_id"))
            pairs = pairs.select("src", "dst", "type", F.col("mentions").cast("double").alias("weight"))  # counted, so that growth adds up to a rebuild
            said = said.unionByName(extraction.stated(triples), allowMissingColumns=True)
        else:
            near = extraction.cooccurrence(found).select("src", "dst", F.lit("NEAR").alias("type"), F.col("weight").cast("double"))
            pairs = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight"))
        nodes = named.groupBy("node_id").agg(F.min("type").alias("type"), F.min("name").alias("name"), F.min("vec_id").alias("vec_id"))
        store.add(nodes, pairs.groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight")), said, {"chunks": upto, "compact": False})
        if store.deltas() > COMPACT_AFTER:
            store.compact()
        return unread

    def build_index(self, metric: str = "l2", cells: int | None = None) -> VectorIndex:
        """An index of the vectors that are there; later ones are searched beside it. It stands aside once vectors are deleted, until it is built again."""
        upto = self.chunks_store.log.version()
        path = f"{self.path}/index/{metric}-{upto}-{uuid.uuid4().hex[:8]}"
        index = VectorIndex.build(self._vectors(), path, metric, cells)
        Versions(self.spark, f"{self.path}/index").commit({}, note={metric: {"path": path, "upto": upto}})
        return index

    def _searched(self, metric: str = "l2") -> DataFrame | VectorIndex:
        """What a search looks into: the index for the metric if there is one that still holds, else all vectors."""
        note = Versions(self.spark, f"{self.path}/index").manifest()["note"].get(metric)
        if not note or self.chunks_store.deleted_since(note["upto"]):
            return self._vectors() if self.settings.index == "none" else self.build_index(metric)
        return VectorIndex(self.spark, note["path"]).beside(self.chunks_store.scan(note["upto"]).where("embedding IS NOT NULL"))

    def _embedded(self, questions: DataFrame) -> DataFrame:
        return stores.embed(questions.select("query_id", F.col("text").alias("page_content")), self.embedder, self.settings.dim).where("embedding IS NOT NULL").select("query_id", "embedding")

    def _vectors(self) -> DataFrame:
        return self.chunks_store.scan().where("embedding IS NOT NULL")

    def _passages(self) -> DataFrame:
        return self.chunks_store.scan().select("vec_id", "page_content")

    def vector(self, questions: DataFrame, k: int | None = None, kind: str | None = None) -> DataFrame:
        kind = kind or self.settings.search_kind
        within = self._searched("cosine" if kind in ("mmr", "similarity_score_threshold") else "l2")
        near = vectors.search(self._embedded(questions), within, k or self.settings.top_k, kind, least=self.settings.least_relevance)
        return near.join(self._passages(), "vec_id").select("query_id", F.col("vec_id").alias("id"), "rank", "page_content", "score")

    def _without(self, questions: DataFrame, found: DataFrame) -> DataFrame:
        return questions.join(found.select("query_id").distinct(), "query_id", "left_anti")

    def seeds(self, questions: DataFrame) -> DataFrame:
        """Nodes of the nearest chunks; a question that has none (or any, by the setting) takes nodes by fuzzy matching. strategy says which."""
        s, nodes = self.settings, self.graph_store.nodes()

        def fuzzy(left: DataFrame) -> DataFrame:
            left = cut(left.select("query_id", "text"))
            if left.isEmpty():
                return self.spark.createDataFrame([], "query_id bigint, node_id string, score double, strategy string")
            found = NameIndex(nodes).fuzzy(left, s.seeds, 4.5 * s.min_score, properties=graph.text_properties(nodes))
            return found.select("query_id", "node_id", "score", F.lit("fuzzy").alias("strategy"))

        if s.seed_strategy == "fuzzy":
            return cut(fuzzy(questions))
        near = vectors.nearest(self._embedded(questions), self._searched(), 2 * s.seeds)
        by_vector = cut(vectors.seed_nodes(near, nodes, s.seeds, s.min_score).select("query_id", "node_id", "score", F.lit("vector").alias("strategy")))
        return cut(by_vector.unionByName(fuzzy(self._without(questions, by_vector)))) if s.fallback else by_vector

    def graph(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """All nodes within reach of the seeds; k, if given, limits the documents of a question."""
        store = self.graph_store
        nodes, edges = store.nodes(), store.edges()
        visited = graph.breadth_first(self.seeds(questions), edges, self.settings.max_hops)
        d = graph.node_documents(visited, nodes, edges, self._passages(), properties=graph.text_properties(nodes))
        d = d.where(F.col("rank") <= k) if k else d
        return d.select("query_id", F.col("node_id").alias("id"), "rank", "page_content", F.col("hop_distance").cast("double").alias("hop_distance"), "relevance_score", F.col("relevance_score").alias("score"))

    def pagerank(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """Seeds are nodes of the nearest chunks, else of matching names; a question without any result takes its nearest chunks instead (retrieval_source says so)."""
        s, nodes = self.settings, self.graph_store.nodes()
        near = vectors.nearest(self._embedded(questions), self._searched(), s.seeds)
        seeds = cut(pagerank.chunk_seeds(near, nodes))
        left = cut(self._without(questions, seeds).select("query_id", "text"))
        if not left.isEmpty():
            names = NameIndex(nodes).fuzzy(left, s.seeds, s.min_score, type_score=by_term).select("query_id", "node_id", "score")
            seeds = cut(seeds.unionByName(names))
        if s.max_nodes:
            ranks = pagerank.personalised_pagerank(seeds, self.graph_store.edges(), s.alpha, s.iterations, s.tolerance, s.max_hops, s.max_nodes)
        else:
            ranks = pagerank.forward_push(seeds, pagerank.transitions(self.graph_store.edges()), s.alpha, s.least_pushed, s.iterations)
        best = pagerank.best_vectors(ranks, nodes, k or s.top_k, s.min_score)
        found = best.join(self._passages(), "vec_id").select("query_id", F.col("vec_id").cast("string").alias("id"), "rank", "page_content", "score", "retrieval_source")
        if not s.fallback:
            return found
        found = cut(found)
        rest = self.vector(self._without(questions, found), k).withColumns({"id": F.col("id").cast("string"), "retrieval_source": F.lit("vector_fallback")})
        return found.unionByName(rest)

    def hybrid(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        s = self.settings
        v = self.vector(questions, k).withColumn("id", F.col("id").cast("string"))
        both = fusion.first_of_content(fusion.combine(v, self.graph(questions), s.hybrid_mode, s.vector_weight, s.graph_weight))
        return both.select("query_id", "id", "rank", "page_content", "score", "retrieval_source")

    def retrieve(self, questions: DataFrame, mode: str = "vector", k: int | None = None) -> DataFrame:
        """questions: query_id, text -> query_id, id, rank, page_content, score."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}; one of {MODES}")
        return getattr(self, mode)(questions, k)

    def reranked(self, questions: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], mode: str = "vector", k: int = 5, fetch: int = 2, threshold: float = 0.0) -> DataFrame:
        """The best k of fetch * k results by a scorer of (queries, documents) in 0..1. A batch whose scoring fails keeps its order."""
        return rerank.by_scorer(self.retrieve(questions, mode, k * fetch).join(questions.select("query_id", "text"), "query_id"), scorer, k, threshold)

    def prompts(self, questions: DataFrame, mode: str = "vector", k: int | None = None) -> DataFrame:
        """query_id, text, context: what a generator is given; a question without results has an empty context."""
        context = fusion.format_context(self.retrieve(questions, mode, k), self.settings.context_chars)
        return questions.join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))

    def answer(self, questions: DataFrame, generator: Generator, mode: str = "vector", k: int | None = None) -> DataFrame:
        """query_id, text, context, answer."""
        asked = self.prompts(questions, mode, k).withColumnRenamed("context", "page_content")
        return rerank.ask(asked, generator, "{document}\n\nQuestion: {query}").withColumnRenamed("page_content", "context")

    def stream_answer(self, question: str, tokens: Callable[[str], Iterator[str]], mode: str = "vector", k: int | None = None) -> Iterator[str]:
        """One question's answer as a generator says it, token by token."""
        (row,) = self.prompts(self.spark.createDataFrame([(0, question)], "query_id bigint, text string"), mode, k).collect()
        yield from tokens(prompts.fill(prompts.get("rag_template"), context=row.context, question=question))

    async def later(self, method: str, *args, **kwargs):
        """Any of the methods above without waiting for it: await engine.later("retrieve", questions, "hybrid")."""
        return await asyncio.to_thread(getattr(self, method), *args, **kwargs)

    def stats(self) -> DataFrame:
        """One row: chunks, those embedded, and the graph's nodes, edges, density, nodes with a vector, indexed ones and orphans."""
        store = self.graph_store
        c = self.chunks_store.scan().agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
        return reduce(DataFrame.join, [c, graph.stats(store.nodes(), store.edges(), self._vectors())])
