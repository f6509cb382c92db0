"""Fuzzy and keyword lookup of nodes by name without comparing every node with every text.

An inverted index lists for each pair of neighbouring characters (in lower case) the names that have it, and for each term likewise. A fuzzy lookup takes two steps:

1. Names that share a text's rarest pairs are compared; the k-th best node so found scores at least tau, and the true k-th best no less.
2. A node can reach tau only if its name alone scores what type and other properties cannot make up for, so its partial ratio has a least value theta. Of two strings, the shorter of m characters with L of them in common
   order with a window of the other, each character that is not in common breaks at most three of the shorter one's pairs (two by its own loss, one by what stands in its place). So at most ``e = 3 m (1 - theta)``
   of these are missing from the longer one, and among the ``e + 1`` rarest at least one is there: only names that share one of those are compared.

Where theta is so low that ``e`` covers all pairs, nothing can be ruled out: short names are then compared by their length, and a text that is open as a whole is compared with all names (``open_texts``). Every way gives
the same rows as comparing all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources.tables import cut

#: Broken pairs a character that is not in common.
BROKEN = 3
#: Pairs of a text, and the names that share most of them, for a first look.
RAREST, FIRST_NAMES = 4, 50
#: Different terms of a text up to which a keyword lookup goes by sets of them (2 ** n - 1), beyond by each one.
MOST_TERMS = 8
#: Characters of the grams by which texts are looked for inside names: of a text, the longest that it has.
GRAMS = (2, 4, 8, 16)


def pairs_of(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    return grams_of(text, 2)


def grams_of(text: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n]+"), lambda t: t != ""))


def by_ratio(text: str, types: pd.Series) -> np.ndarray:
    return 0.01 * graph.ratios(text, types)


def by_term(text: str, types: pd.Series) -> np.ndarray:
    return 0.1 * types.fillna("").str.lower().isin(set(text.split())).to_numpy()


class NameIndex:
    """nodes: node_id, type, name and any properties."""

    def __init__(self, nodes: DataFrame):
        self.spark = nodes.sparkSession
        self.nodes = cut(nodes.withColumn("value", F.lower("name")))

    @cached_property
    def values(self) -> DataFrame:
        values = self.nodes.where("value IS NOT NULL").select("value").distinct().withColumn("p", pairs_of(F.col("value")))
        return cut(values.select("value", F.length("value").alias("length"), F.size("p").alias("pairs"), "p"))

    @cached_property
    def names(self) -> DataFrame:
        return self.values.drop("p")

    @cached_property
    def rarity(self) -> DataFrame:
        return cut(self.values.select(F.explode("p").alias("pair")).groupBy("pair").agg(F.count("*").alias("names")))

    def _posted(self, asked: DataFrame) -> DataFrame:
        """pair, value, length of the names that have one of the pairs asked for: a pass over the names, without a list of all pairs of all names."""
        wanted = asked.select("pair").distinct()
        return self.values.select("value", "length", F.explode("p").alias("pair")).join(wanted, "pair", "left_semi")

    @staticmethod
    def _once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each different text once, under the least query_id that asks it; and query_id, asked_as of all queries."""
        given = cut(queries.where("text IS NOT NULL").select("query_id", "text"))
        texts = cut(given.groupBy("text").agg(F.min("query_id").alias("query_id")).select("query_id", "text"))
        return texts, given.join(texts.withColumnRenamed("query_id", "asked_as"), "text").select("query_id", "asked_as")

    @staticmethod
    def _for_all(found: DataFrame, asked: DataFrame) -> DataFrame:
        """What was found for each text, for each query that asks it."""
        rest = [c for c in found.columns if c != "query_id"]
        return asked.join(found.withColumnRenamed("query_id", "asked_as"), "asked_as").select("query_id", *rest)

    def _nodes_of(self, values: DataFrame, k: int, columns: list[str]) -> DataFrame:
        """The first k nodes by id of each combination of columns, of the names in values: as all of one combination score the same for a text, no other can be among its best k."""
        place = F.row_number().over(Window.partitionBy(*columns).orderBy("node_id"))
        some = self.nodes.select("node_id", *columns).join(values.select("value").distinct(), "value", "left_semi")
        return some.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """query_id, text, pair, names that have it, place (rarest first: pairs that no name has lead, as none shares them)."""
        q = queries.select("query_id", F.lower("text").alias("text")).withColumn("pair", F.explode(pairs_of(F.col("text"))))
        q = q.join(self.rarity, "pair", "left").withColumn("names", F.coalesce("names", F.lit(0).cast("long")))
        return cut(q.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("names", "pair"))))

    def _compared(self, candidates: DataFrame) -> DataFrame:
        """query_id, text, value -> with ratio."""

        def run(batches):
            for pdf in batches:
                yield pdf.assign(ratio=np.array([graph.partial_ratio(a, b) for a, b in zip(pdf["text"], pdf["value"], strict=True)], float))

        return candidates.mapInPandas(run, "query_id bigint, text string, value string, ratio double")

    def _types(self, queries: DataFrame, type_score: Callable[[str, pd.Series], np.ndarray]) -> DataFrame:
        """query_id, type, type_score: each text with each type, of which there are few."""

        def run(batches):
            for pdf in batches:
                yield pdf.assign(type_score=[float(type_score(a, pd.Series([b], dtype=object))[0]) for a, b in zip(pdf["text"], pdf["type"], strict=True)])

        listed = self.nodes.agg(F.collect_set(F.struct("type")).alias("types"))
        each = queries.select("query_id", F.lower("text").alias("text")).join(F.broadcast(listed)).select("query_id", "text", F.explode("types").alias("t")).select("query_id", "text", "t.type")
        return cut(each.mapInPandas(run, "query_id bigint, text string, type string, type_score double").select("query_id", "type", "type_score"))

    def _scored(self, compared: DataFrame, types: DataFrame, k: int, properties: list[str]) -> DataFrame:
        """query_id, node_id, raw of the nodes of compared names, added up as the full scan does; of nodes that look the same the first k."""
        compared = cut(compared)
        at = compared.join(self._nodes_of(compared, k, ["value", "type", *properties]), "value")
        at = at.join(types.withColumnsRenamed({"query_id": "q", "type": "t"}), (F.col("query_id") == F.col("q")) & F.col("type").eqNullSafe(F.col("t")))
        raw = F.col("ratio") * 0.03 + F.col("type_score")
        if not properties:
            return at.select("query_id", "node_id", raw.alias("raw"))

        def run(batches):
            for pdf in batches:
                ratios = lambda p: np.array([graph.partial_ratio(t, v.lower()) if isinstance(v, str) else 0.0 for t, v in zip(pdf["text"], pdf[p], strict=True)], float)
                yield pd.DataFrame({"query_id": pdf["query_id"], "node_id": pdf["node_id"], "raw": sum((0.005 * ratios(p) for p in properties), pdf["raw"].to_numpy(float))})

        return at.select("query_id", "node_id", "text", *properties, raw.alias("raw")).mapInPandas(run, "query_id bigint, node_id string, raw double")

    def candidates(self, queries: DataFrame, types: DataFrame, k: int, least: float, scale: float, properties: list[str]) -> tuple[DataFrame, DataFrame]:
        """query_id, text, value of all names that a text's best k nodes may have; and the texts that are open to all names, which are left out of it."""
        asked = self._asked(queries)
        look = asked.where(F.col("names") > 0).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("nth") <= RAREST)
        look = cut(look.select("query_id", "text", "pair"))
        look = look.join(self._posted(look).select("pair", "value"), "pair").groupBy("query_id", "text", "value").agg(F.count("*").alias("shared"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), F.length("value"), "value"))
        look = look.withColumn("nth", nth).where(F.col("nth") <= max(FIRST_NAMES, 4 * k)).select("query_id", "text", "value")
        first = self._scored(self._compared(look), types, k, properties)
        first = first.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw")))).where(F.col("nth") == k)
        tau = first.select("query_id", F.least("raw", F.lit(scale)).alias("tau"))  # scores above scale are equal
        best_type = types.groupBy("query_id").agg(F.max("type_score").alias("best_type"))
        q = queries.select("query_id", F.lower("text").alias("text")).join(tau, "query_id", "left").join(best_type, "query_id", "left")
        theta = (F.greatest(F.coalesce("tau", F.lit(least)), F.lit(least)) - F.col("best_type") - 0.5 * len(properties)) / 3 - 1e-9
        q = cut(q.select("query_id", "text", F.coalesce(theta, F.lit(0.0)).alias("theta"), F.length("text").alias("m"), F.size(pairs_of(F.col("text"))).alias("own_pairs")))
        broken = lambda m: F.floor(BROKEN * m * (1 - F.col("theta")) + 1e-6)
        is_open = (F.col("theta") <= 0) | (broken(F.col("m")) >= F.col("own_pairs"))
        shut = q.where(~is_open)
        near = cut(asked.select("query_id", "pair", "place").join(shut, "query_id"))
        # names no shorter than the text: one of the text's rarest pairs; shorter ones: one of their own, whose order is found for names below the longest text only
        rarest = near.where(F.col("place") <= broken(F.col("m")) + 1)
        longer = rarest.join(self._posted(rarest), "pair").where(F.col("length") >= F.col("m"))
        loosest = shut.agg(F.min("theta").alias("loosest"), F.max("m").alias("longest"))
        below = self.values.join(F.broadcast(loosest), F.col("length") < F.col("longest")).select("value", "length", "loosest", F.explode("p").alias("pair")).join(self.rarity, "pair")
        own = F.row_number().over(Window.partitionBy("value").orderBy("names", "pair"))
        rare = below.withColumn("name_place", own).where(F.col("name_place") <= F.floor(BROKEN * F.col("length") * (1 - F.col("loosest")) + 1e-6) + 1).select("pair", "value", "length", "name_place")
        shorter = near.join(rare, "pair").where((F.col("length") < F.col("m")) & (F.col("name_place") <= broken(F.col("length")) + 1))
        by_pair = longer.select("query_id", "text", "value").union(shorter.select("query_id", "text", "value"))
        # names shorter than the text of which all pairs may be broken, by length and number of pairs
        kinds = self.names.select("length", "pairs").distinct()
        short = shut.select("query_id", "text", "theta", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("length")).join(kinds, "length")
        by_length = short.where(broken(F.col("length")) >= F.col("pairs")).join(self.names, ["length", "pairs"])
        chosen = by_pair.union(by_length.select("query_id", "text", "value")).distinct()
        return cut(chosen), q.where(is_open).select("query_id", "text")

    def fuzzy(self, queries: DataFrame, k: int, least: float = 0.0, scale: float = 4.5, properties: list[str] | None = None, type_score: Callable[[str, pd.Series], np.ndarray] = by_ratio) -> DataFrame:
        """query_id, node_id, score, rank: the best k nodes of each query (query_id, text) by 0.03 times the partial ratio of the name, the score of the type, and 0.005 times that of each other property, if that is
        at least `least`; over scale and at most 1. The same rows as graph.fuzzy_seeds gives."""
        more = properties or []
        given, asked = self._once(queries)
        types = self._types(given, type_score)
        chosen, open_texts = self.candidates(given, types, k, least, scale, more)
        found = self._scored(self._compared(chosen), types, k, more).where(F.col("raw") >= least)
        found = found.select("query_id", "node_id", F.least(F.lit(1.0), F.col("raw") / scale).alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)

        def score(text: str, pdf: pd.DataFrame) -> np.ndarray:
            return sum((0.005 * graph.ratios(text, pdf[p]) for p in more), graph.ratios(text, pdf["name"]) * 0.03 + type_score(text, pdf["type"]))

        return self._for_all(found.unionByName(graph.text_seeds(open_texts, self.nodes, k, score, ["name", "type", *more], least, scale)), asked)

    def compared(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, compared: names that a fuzzy lookup of each query compares in its second step."""
        given, asked = self._once(queries)
        chosen, open_texts = self.candidates(given, self._types(given, by_ratio), k, 0.0, 4.5, [])
        whole = open_texts.select("query_id").join(F.broadcast(self.names.agg(F.count("*").alias("compared"))))
        counts = given.select("query_id").join(chosen.groupBy("query_id").agg(F.count("*").alias("compared")), "query_id", "left").join(open_texts.select("query_id"), "query_id", "left_anti")
        return self._for_all(counts.select("query_id", F.coalesce("compared", F.lit(0)).alias("compared")).union(whole), asked)

    @staticmethod
    def _first(nodes: DataFrame, k: int, columns: list[str]) -> DataFrame:
        """The first k nodes by id of each combination of columns."""
        place = F.row_number().over(Window.partitionBy(*columns).orderBy("node_id"))
        return nodes.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")

    def _with_terms(self, texts: DataFrame, k: int) -> DataFrame:
        """query_id, node_id, name, type of all nodes that terms alone may bring among a text's best k.

        A node that has the terms S of a text scores no more than any of its type that has all of S, so only the first k by id of those, a type, matter: for each different set that is asked, not for each text.
        A set is looked up by its term of the fewest nodes. Before that, of nodes with the same asked terms and type the first k are kept. Texts of more than MOST_TERMS terms go by each of their terms."""
        t = texts.select("query_id", F.array_sort(terms_of(F.col("small"))).alias("t")).where(F.size("t") > 0)
        t = cut(t.withColumn("short", F.size("t") <= MOST_TERMS))
        asked = t.select(F.explode("t").alias("term")).distinct()
        named = self.nodes.where("value IS NOT NULL").select("node_id", "name", "type", F.explode(terms_of(F.col("value"))).alias("term")).join(asked, "term", "left_semi")
        signed = named.groupBy("node_id", "name", "type").agg(F.array_sort(F.collect_list("term")).alias("has"))
        some = cut(self._first(signed, k, ["has", "type"]))
        by_term = some.withColumn("term", F.explode("has"))
        size = by_term.groupBy("term").agg(F.count("*").alias("nodes"))
        picked = F.expr("explode(sequence(1, shiftleft(1, size(t)) - 1))").alias("bits")
        # bit i of bits says whether the i-th term is in the set
        inside = F.expr("filter(t, (x, i) -> (shiftright(bits, i) & 1) = 1)")
        sets = cut(t.where("short").select("query_id", "t", picked).select("query_id", inside.alias("terms")))
        each = sets.select("terms").distinct().withColumn("term", F.explode("terms")).join(size, "term", "left")
        rarest = each.groupBy("terms").agg(F.min(F.struct(F.coalesce("nodes", F.lit(0)).alias("nodes"), "term")).alias("least")).select("terms", "least.*").where("nodes > 0").select("terms", "term")
        having = rarest.join(by_term, "term").where(F.size(F.array_intersect("terms", "has")) == F.size("terms")).select("terms", "node_id", "name", "type")
        by_set = sets.join(self._first(having, k, ["terms", "type"]), "terms").select("query_id", "node_id", "name", "type")
        by_each = t.where("NOT short").select("query_id", F.explode("t").alias("term")).join(by_term, "term").select("query_id", "node_id", "name", "type")
        return by_set.union(by_each)

    def _holding(self, texts: DataFrame, k: int) -> DataFrame:
        """query_id, node_id, name, type of the first k nodes of each type whose name holds the text: they score the same. They are looked for by the text's gram that the fewest names have."""
        n = F.coalesce(*(F.when(F.length("small") >= g, F.lit(g)) for g in sorted(GRAMS, reverse=True)))
        of_size = lambda text, g: F.transform(grams_of(text, g), lambda x: F.struct(F.lit(g).alias("n"), x.alias("gram")))
        own = texts.select("query_id", "small", n.alias("size")).where("size IS NOT NULL")
        grams = F.explode(F.coalesce(*(F.when(F.col("size") == g, of_size(F.col("small"), g)) for g in GRAMS)))
        own = cut(own.select("query_id", "small", grams.alias("g")).select("query_id", "small", "g.gram"))
        sizes = [r.n for r in own.select(F.length("gram").alias("n")).distinct().collect()]
        if not sizes:
            return self.nodes.select(F.lit(0).cast("bigint").alias("query_id"), "node_id", "name", "type").where("false")
        wanted = own.select("gram").distinct()
        parts = []
        for g in sizes:
            placed = self.nodes.where(F.length("value") >= g).select("node_id", "value", "name", "type", F.explode(F.sequence(F.lit(1), F.length("value") - (g - 1))).alias("at"))
            parts.append(placed.select("node_id", "value", "name", "type", F.substring("value", F.col("at"), F.lit(g)).alias("gram")))
        listed = reduce(DataFrame.union, parts).join(wanted, "gram", "left_semi")
        # a gram that repeats in a name gives its node twice, so places are not counted by rows
        place = F.dense_rank().over(Window.partitionBy("gram", "value", "type").orderBy("node_id"))
        some = cut(listed.withColumn("_n", place).where(F.col("_n") <= k).drop("_n").distinct())
        size = some.groupBy("gram").agg(F.count("*").alias("nodes"))
        rarest = own.join(size, "gram", "left").groupBy("query_id", "small").agg(F.min(F.struct(F.coalesce("nodes", F.lit(0)).alias("nodes"), "gram")).alias("least"))
        rarest = rarest.select("query_id", "small", "least.*").where("nodes > 0").select("query_id", "small", "gram")
        found = rarest.join(some, "gram").where(F.contains("value", "small")).select("query_id", "node_id", "name", "type")
        return self._first(found, k, ["query_id", "type"])

    def keyword(self, queries: DataFrame, k: int, min_score: float = 1e-9) -> DataFrame:
        """The rows of graph.keyword_seeds: only nodes that share terms with the text, or whose name holds it, or the first k of a type that holds it, can score among the best k."""
        q, asked = self._once(queries)
        q = cut(q.withColumn("small", F.lower("text")))
        long = q.where(F.length("text") >= 2)
        kinds = self.nodes.agg(F.collect_set("type").alias("types"))
        by_type = long.join(F.broadcast(kinds)).select("query_id", "small", F.explode("types").alias("type")).where(F.contains(F.lower("type"), F.col("small"))).select("query_id", "type")
        # nodes that have nothing but their type score the same, so the first k of a type will do
        of_type = self._first(self.nodes.where("name IS NOT NULL").select("node_id", "type", "name"), k, ["type"])
        some = self._with_terms(long, k).union(self._holding(long, k)).union(by_type.join(of_type, "type").select("query_id", "node_id", "name", "type")).dropDuplicates(["query_id", "node_id"])
        score = graph.keyword_score(F.col("text"), F.col("name"), F.col("type"))
        scored = some.join(q.select("query_id", "text"), "query_id").withColumn("score", score).where(F.col("score") >= min_score)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
        found = scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "node_id", "score", "rank")
        return self._for_all(found.unionByName(graph.keyword_seeds(q.where(F.length("text") < 2).select("query_id", "text"), self.nodes, k, min_score)), asked)
