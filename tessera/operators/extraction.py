"""Entities and relations from text by rule, and parsers for relations that a text generator wrote."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import prompts as prompts_

#: Two capitalised words of ASCII letters; word boundaries differ between engines and are not used.
NAME_PATTERN = "[A-Z][a-z]+ [A-Z][a-z]+"


def canonical(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, "[ \t\n]+", " ")))


def mentions(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = NAME_PATTERN) -> DataFrame:
    """doc_id, mention_index, name: every match, in order."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    return chunks.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("mention_index", "name"))


def mentions_in_context(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = NAME_PATTERN, around: int = 60, kind: str = "ENTITY") -> DataFrame:
    """doc_id, mention_index, name, kind, start, end, context: every match with its place in characters and the text around it."""
    text = F.col(text_col)
    d = chunks.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("names"), F.split(text, pattern, -1).alias("pieces"))
    long = lambda parts: F.aggregate(F.transform(parts, lambda x: F.length(x)), F.lit(0), lambda a, b: a + b)
    d = d.select("doc_id", "t", "pieces", "names", F.posexplode("names").alias("mention_index", "name"))
    start = long(F.slice("pieces", F.lit(1), F.col("mention_index") + 1)) + long(F.slice("names", F.lit(1), F.col("mention_index")))
    d = d.withColumn("start", start).withColumn("end", F.col("start") + F.length("name"))
    first = F.greatest(F.col("start") - around, F.lit(0))
    return d.select("doc_id", "mention_index", "name", F.lit(kind).alias("kind"), "start", "end", F.col("t").substr(first + 1, F.col("end") + around - first).alias("context"))


def entities(found: DataFrame, scope: str = "corpus") -> DataFrame:
    """A node a canonical name (in the corpus or in each document), its spelling that comes first, and how often and where it is mentioned."""
    key = canonical(F.col("name"))
    by = [key.alias("key")] + ([F.col("doc_id").alias("scope")] if scope == "document" else [])
    return found.groupBy(*by).agg(F.min("name").alias("name"), F.count("*").alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs")).withColumn("node_id", F.md5(F.concat_ws("|", *(["key", F.col("scope").cast("string")] if scope == "document" else ["key"]))))


def cooccurrence(found: DataFrame, most: int | None = None) -> DataFrame:
    """src, dst, weight: neighbouring names of a document (each with the next `most`, one by default), which keeps edges linear in the mentions."""
    reach = most or 1
    m = found.select("doc_id", "mention_index", canonical(F.col("name")).alias("key"))
    later = m.select("doc_id", F.explode(F.sequence(F.col("mention_index") - reach, F.col("mention_index") - 1)).alias("mention_index"), F.col("key").alias("other"))
    pairs = m.join(later, ["doc_id", "mention_index"]).where("key <> other")
    return pairs.groupBy(F.least("key", "other").alias("src"), F.greatest("key", "other").alias("dst")).agg(F.count("*").alias("weight"))


def link_entities(found: DataFrame, known: DataFrame) -> DataFrame:
    """Mentions with the node of the same canonical name, if known (node_id, name) has one: the least id."""
    keys = known.groupBy(canonical(F.col("name")).alias("key")).agg(F.min("node_id").alias("node_id"))
    return found.withColumn("key", canonical(F.col("name"))).join(keys, "key", "left")


def normal_relation(name: Column) -> Column:
    """RELATED_TO style: upper case, other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), "[^A-Z0-9]+", "_"), "^_|_$", "")


_TRIPLE = "struct<subject:string,relationship:string,object:string>"


def _triple(s: Column, p: Column, o: Column) -> Column:
    return F.struct(F.trim(s).alias("subject"), F.trim(p).alias("relationship"), F.trim(o).alias("object"))


def _none() -> Column:
    return F.array().cast(f"array<{_TRIPLE}>")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def parse_json(text: Column) -> Column:
    """Triples of JSON as generators write it: a list, the list under "relationships" or one object, among code fences and prose, with names in any or no quotes and commas too many."""
    bare = F.regexp_replace(F.regexp_replace(text, "```[A-Za-z]*", ""), r",(\s*[}\]])", "$1")
    lenient = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    listed = F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), f"array<{_TRIPLE}>", lenient)
    single = F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), _TRIPLE, lenient)
    clean = lambda found: F.filter(F.transform(found, lambda t: F.struct(*(F.coalesce(t[k], F.lit("")).alias(k) for k in ("subject", "relationship", "object")))), lambda t: (t["subject"] != "") | (t["object"] != ""))
    found = F.coalesce(clean(listed), _none())
    return F.when(F.size(found) > 0, found).otherwise(F.coalesce(clean(F.array(single)), _none()))


def parse_table(text: Column) -> Column:
    """Rows of a Markdown table whose header names subject, relationship and object; separators and short rows are skipped."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = F.transform(F.filter(_lines(text), lambda x: F.contains(x, F.lit("|"))), cells)
    header = F.transform(rows[0], lambda c: F.lower(c))
    at = {k: F.array_position(header, k).cast("int") for k in ("subject", "relationship", "object")}
    body = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), lambda r: ~F.forall(r, lambda c: F.regexp_like(c, F.lit("^:?-*:?$"))) & (F.size(r) >= F.greatest(*at.values())))
    found = F.transform(body, lambda r: _triple(*(F.try_element_at(r, at[k]) for k in ("subject", "relationship", "object"))))
    known = (at["subject"] > 0) & (at["relationship"] > 0) & (at["object"] > 0)
    return F.when((F.size(rows) > 1) & known, found).otherwise(_none())


def _bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^(?:[-*•]|[0-9]+[.)])[ \t]+", ""))


_ARROW = r"^(.+?)[ \t]*-+[ \t]*([^->]+?)[ \t]*-+>[ \t]*(.+)$"


def _arrow(line: Column) -> Column:
    parts = [F.regexp_extract(line, _ARROW, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", _triple(*parts))


def parse_delimited(text: Column) -> Column:
    """Lines of three or more parts between pipes, else semicolons, else an arrow; bullets go."""

    def one(line: Column) -> Column:
        line = _bare(line)
        cut = F.when(F.contains(line, F.lit("|")), F.split(line, r"\|")).when(F.contains(line, F.lit(";")), F.split(line, ";"))
        return F.when(F.size(cut) >= 3, _triple(cut[0], cut[1], cut[2])).otherwise(_arrow(line))

    return F.filter(F.transform(_lines(text), one), lambda t: t.isNotNull())


def parse_arrow(text: Column) -> Column:
    """Lines of the form subject - relationship -> object."""
    return F.filter(F.transform(_lines(text), lambda x: _arrow(_bare(x))), lambda t: t.isNotNull())


PARSERS = {"json": parse_json, "table": parse_table, "delimited": parse_delimited, "arrow": parse_arrow}


def parse_relations(text: Column, preferred: str = "auto", custom: Callable[[Column], Column] | None = None) -> Column:
    """First of JSON, table, delimited and arrow parsing that finds any triple; a preferred one is tried first, a custom parser (text -> array of triples) before all."""
    order = sorted(PARSERS, key=lambda name: name != preferred)  # stable: the others keep their order
    found = [f(text) for f in ([custom] if custom else []) + [PARSERS[name] for name in order]]
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in found), _none())


def ask_each(chunks: DataFrame, generator: Callable[[list[str]], list[str]], template: str, text_col: str = "page_content", tries: int = 2, **values: str) -> DataFrame:
    """chunks with answer and error: what a generator says to the template filled with each text (text, document, source_text) and values. A batch that fails is tried
    again; if it still fails its rows carry the error and no answer."""

    def run(batches):
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            prompts = [prompts_.fill(template, text=t, document=t, source_text=t, **{"entities": "", "relationship_types": "", **values}) for t in texts]
            for _ in range(tries):
                try:
                    answers, error = generator(prompts), None
                    break
                except Exception as e:  # what a remote model raises is unknown; it is kept in the row
                    answers, error = [None] * len(texts), str(e)
            yield pdf.assign(answer=pd.Series(answers, dtype=object, index=pdf.index), error=error)

    return chunks.mapInPandas(run, T.StructType([*chunks.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]))


def relations(answered: DataFrame, id_col: str = "vec_id", preferred: str = "auto", custom: Callable[[Column], Column] | None = None) -> DataFrame:
    """vec_id, pos, subject, relationship, object of all answers."""
    found = answered.select(F.col(id_col).alias("vec_id"), F.posexplode(parse_relations(F.coalesce("answer", F.lit("")), preferred, custom)).alias("pos", "t"))
    return found.select("vec_id", "pos", "t.subject", "t.relationship", "t.object").where((canonical(F.col("subject")) != "") & (canonical(F.col("object")) != ""))


def ensure_nodes(triples: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of triples: each end is the known node (node_id, name) of its canonical name, the least id, or a new ENTITY named after it; mentions are counted, edges are
    once a (src, dst, type), with the first chunk that states them."""
    ends = triples.select("vec_id", F.explode(F.array("subject", "object")).alias("name")).withColumn("key", canonical(F.col("name")))
    named = known.groupBy(canonical(F.col("name")).alias("key")).agg(F.min("node_id").alias("known_id"))
    nodes = ends.groupBy("key").agg(F.min("name").alias("name"), F.min("vec_id").alias("vec_id"), F.count("*").alias("mentions")).join(named, "key", "left")
    nodes = nodes.select("key", F.coalesce("known_id", "key").alias("node_id"), F.lit("ENTITY").alias("type"), "name", "vec_id", "mentions", F.col("known_id").isNull().alias("created"))
    at = lambda side: nodes.select(F.col("key").alias(f"{side}_key"), F.col("node_id").alias(side))
    placed = triples.withColumns({"src_key": canonical(F.col("subject")), "dst_key": canonical(F.col("object"))}).join(at("src"), "src_key").join(at("dst"), "dst_key")
    edges = placed.groupBy("src", "dst", F.col("relationship").alias("type")).agg(F.lit(1.0).alias("weight"), F.min("vec_id").alias("vec_id"), F.count("*").alias("mentions"))
    return nodes.drop("key"), edges


def stated(triples: DataFrame) -> DataFrame:
    """node_id, vec_id, mention_index, name, kind, context: each end of each triple as a mention of its node, with the statement as its context."""
    said = F.concat_ws(" ", "subject", "relationship", "object")
    ends = triples.select("vec_id", "pos", said.alias("context"), F.posexplode(F.array("subject", "object")).alias("side", "name"))
    return ends.select(canonical(F.col("name")).alias("node_id"), "vec_id", (2 * F.col("pos") + F.col("side")).alias("mention_index"), "name", F.lit("ENTITY").alias("kind"), "context")


def parse_terms(text: Column, most: int) -> Column:
    """Suggested terms: a JSON list, else lines without bullets and quotes; ordered distinct, at most `most`."""
    listed = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<string>")
    lines = F.transform(_lines(text), lambda x: F.trim(F.regexp_replace(_bare(x), "^[\"']|[\"',]+$", "")))
    terms = F.filter(F.coalesce(listed, lines), lambda x: x != "")
    return F.slice(F.array_distinct(terms), 1, most)
