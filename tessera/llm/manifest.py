"""A Merkle manifest of a dataset, built and checked by Pregel-style supersteps over RDDs.

Every row is a leaf; the leaves of a language, in order of their ids, form a tree, and the roots of these trees, in order of their languages, form one more.
A vertex is a node of a tree. Upward, children send their digests to the ancestor ``levels`` levels above; it is complete when all children that the size of its tree says it
has are there (else the step fails), hashes what lies between and sends its own digest on. The messages of one superstep meet in groups of at most ``2 ** levels`` digests, whatever the size of
a tree, and each superstep is written to the shared folder, so a lost executor costs a step. Downward, complete nodes send the siblings
beside their path to the root down to their children; a leaf folds its digest with them. Only the numbers of nodes pass the driver, and the root.

A run is two consecutive nodes of a level (the last may be one alone) and becomes H of their digests; H is the lower-case hex SHA-256 of concatenated inputs, digests as hex text.

Defined cases: a null field is ``-`` and any other ``<UTF-8 bytes>:<value>``; rows without an id come first in their tree, rows that share an id are ordered by their leaf digests;
equal rows are leaves each; a null language is the first tree and differs from an empty one; a tree of one leaf has that leaf as its root, and so have the manifest of one language its
root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.work import Work, buckets_for

#: Levels that a superstep climbs: the vertex program sees at most 2 ** LEVELS children.
LEVELS = 8
#: Nodes a task.
TASK_NODES = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree string, place bigint, total bigint, digest string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The digest of a row's fields."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256)


def places(df: DataFrame, tree: str, order: list[str], work: Work, rows: int) -> DataFrame:
    """df with place (from 0, within its tree, in the given order) and total (rows of the tree), without a window over a tree: rows are range-sorted,
    numbered within their tasks, and moved on by the counts of the tasks before, which are one row a task and tree."""
    parts = buckets_for(df.sparkSession, rows, TASK_NODES)
    keys = [tree, *order]
    df = df.withColumn("_nth", F.monotonically_increasing_id())  # splits rows that are equal in all keys
    ranged = df.repartitionByRange(parts, *keys, "_nth").sortWithinPartitions(*keys, "_nth").withColumn("_at", F.monotonically_increasing_id()).drop("_nth")
    ranged = work.keep(ranged.withColumn("_part", F.shiftright("_at", 33)), "ranged")
    counts = ranged.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(tree)
    counts = counts.withColumns({"_before": F.sum("_n").over(own.orderBy("_part")) - F.col("_n"), "total": F.sum("_n").over(own)})
    return ranged.join(counts, [tree, "_part"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_n", "_before")


def climb(digests: list[str], total: int, levels: int) -> list[list[str]]:
    """Consecutive nodes, from an even place on, and their ancestors: a list a level, until one node of the tree is left or levels are climbed."""
    rows = [digests]
    for _ in range(levels):
        if total == 1:
            break
        d = rows[-1]
        rows.append([h(*d[i : i + 2]) for i in range(0, len(d), 2)])
        total = (total + 1) // 2
    return rows


def path(rows: list[list[str]], i: int) -> str:
    """The siblings of node i of the first row on its way up: ``<digest`` (left), ``>digest`` (right) or ``.`` (alone), lowest first."""
    out = []
    for row in rows[:-1]:
        k = i ^ 1
        out.append("." if k >= len(row) else f"{'<' if k < i else '>'}{row[k]}")
        i >>= 1
    return "".join(out)


def steps(way: str) -> Iterator[tuple[str, str]]:
    """(side, digest) of each level of a path."""
    i = 0
    while i < len(way):
        n = 0 if way[i] == "." else 64
        yield way[i], way[i + 1 : i + 1 + n]
        i += 1 + n


def fold(digest: str, way: str) -> str:
    """The root that a leaf and its siblings give."""
    for side, other in steps(way):
        digest = h(other, digest) if side == "<" else h(digest, other)
    return digest


def proof(way: str) -> str:
    return h(*(other for _, other in steps(way)))


def _home(key: tuple[str, int]) -> int:
    return zlib.crc32(f"{key[1]}/{key[0]}".encode())


def _full(key: tuple[str, int], total: int, levels: int, children: int) -> None:
    expected = min(1 << levels, total - (key[1] << levels))
    if children != expected:
        raise ValueError(f"node {key} has {children} of {expected} children")


def _forward(levels: int) -> Callable:
    """A parent's step: when its children are complete, its own digest for the parent above."""

    def run(item: tuple) -> tuple:
        key, messages = item
        nodes = sorted(messages)
        total = nodes[0][1]
        _full(key, total, levels, len(nodes))
        top = climb([d for _, _, d in nodes], total, levels)[-1]
        for _ in range(levels):
            total = (total + 1) // 2
        return key[0], key[1], total, top[0]

    return run


def ascend(nodes: DataFrame, work: Work, levels: int) -> list[DataFrame]:
    """nodes: tree, place, total, digest -> the nodes that send messages in each superstep; the last are the roots of the trees."""
    spark, tiers = nodes.sparkSession, [nodes]
    most, rows = nodes.agg(F.max("total"), F.count("*")).first()
    while len(tiers) == 1 or most > 1:
        sent = tiers[-1].select("tree", "place", "total", "digest").rdd.map(lambda v: ((v[0], v[1] >> levels), (v[1], v[2], v[3])))
        tops = sent.groupByKey(_tasks(spark, rows, len(tiers) == 1), _home).map(_forward(levels))
        tiers.append(work.keep(spark.createDataFrame(tops, _NODE, verifySchema=False), f"up{len(tiers)}"))
        most, rows = math.ceil(most / (1 << levels)), tiers[-1].count()
    return tiers


def _tasks(spark: SparkSession, rows: int, first: bool) -> int:
    return buckets_for(spark, rows, TASK_NODES) if first else 1 + rows // TASK_NODES


def _spread(levels: int, reach: Callable) -> Callable:
    """A parent's step downward: each of its children gets the siblings beside its path, and what the parent has been told."""

    def run(item: tuple) -> Iterator[tuple]:
        key, (children, told) = item
        nodes = sorted(children, key=lambda v: v[0])
        told = list(told)
        if not nodes or len(told) != 1:
            raise ValueError(f"node {key} has {len(nodes)} children and {len(told)} messages from above")
        way, subroot = told[0]
        total = nodes[0][1]
        _full(key, total, levels, len(nodes))
        rows = climb([v[2] for v in nodes], total, levels)
        for i, v in enumerate(nodes):
            yield reach(key[0], v, path(rows, i) + way, subroot)

    return run


def descend(tiers: list[DataFrame], told: RDD, work: Work, levels: int, payload: list[str], reach: Callable, schema: str) -> DataFrame:
    """told: ((tree, place), (path, subroot)) for the nodes of the last tier -> a row for each node of the first, made by reach(tree, (place, total, digest, *payload), path, subroot)."""
    spark = tiers[0].sparkSession
    for k in range(len(tiers) - 2, -1, -1):
        rows = tiers[k].select("tree", "place", "total", "digest", *(payload if k == 0 else []))
        children = rows.rdd.map(lambda v: ((v[0], v[1] >> levels), (0, tuple(v[1:]))))
        both = children.union(told.map(lambda m: (m[0], (1, m[1])))).groupByKey(_tasks(spark, rows.count(), k == 0), _home)
        parted = both.mapValues(_two_kinds)
        if k == 0:
            return spark.createDataFrame(parted.flatMap(_spread(levels, reach)), schema, verifySchema=False)
        down = parted.flatMap(_spread(levels, lambda tree, v, way, subroot: (tree, v[0], way, subroot)))
        kept = work.keep(spark.createDataFrame(down, "tree string, place bigint, way string, subroot string", verifySchema=False), f"down{k}")
        told = kept.rdd.map(lambda m: ((m[0], m[1]), (m[2], m[3])))
    raise AssertionError("ascend gives two tiers at least")


def _two_kinds(messages) -> tuple[list, list]:
    children, told = [], []
    for kind, m in messages:
        (told if kind else children).append(m)
    return children, told


def manifest(docs: DataFrame, changed: Callable[[str], Column] | None = None, levels: int = LEVELS, id_col: str = "doc_id") -> DataFrame:
    """doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified of every row.

    changed: gives for the name of a field the value that the field has when it is verified (a column over docs), if that may differ from what was put into the manifest.
    """
    spark, work = docs.sparkSession, Work(docs.sparkSession, "manifest")
    own = [docs[id_col], *(docs[c] for c in FIELDS[1:])]
    later = [changed(c) if changed else v for c, v in zip(FIELDS, own, strict=True)]
    kind = docs.schema[id_col].dataType.simpleString()
    tree = F.when(docs["lang"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs["lang"].cast("string")))
    leaves = docs.select(own[0].alias("id"), tree.alias("tree"), leaf(*own).alias("digest"), leaf(*later).alias("seen"))
    leaves = work.keep(leaves.withColumn("seen", F.when(F.col("seen") != F.col("digest"), F.col("seen"))), "leaves")
    out = f"doc_id {kind}, leaf string, subroot string, root string, path string, proof_sha256 string, folded_root string, verified boolean"
    n = leaves.count()
    if not n:
        return spark.createDataFrame([], out)
    tiers = ascend(work.keep(places(leaves, "tree", ["id", "digest"], work, n), "placed"), work, levels)
    roots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = ascend(work.keep(places(roots, "tree", ["name"], work, roots.count()), "roots"), work, levels)
    root = tops[-1].first().digest
    above = descend(tops, spark.sparkContext.parallelize([(("", 0), ("", root))], 1), work, levels, ["name"], lambda _, v, way, __: (v[3], way, v[2]), "tree string, way string, subroot string")
    told = work.keep(above, "above").rdd.map(lambda m: ((m[0], 0), (m[1], m[2])))

    def reach(_: str, v: tuple, way: str, subroot: str) -> tuple:
        folded = fold(v[4] or v[2], way)
        return v[3], v[2], subroot, root, way, proof(way), folded, folded == root

    return descend(tiers, told, work, levels, ["id", "seen"], reach, out)
