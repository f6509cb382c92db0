"""Document fingerprints: a Merkle tree over sections, blocks and phrases, with DataFrame functions alone.

One rule cuts texts of any length and script. A text is a row of units (a word, or up to 24 characters of one, or an ideograph, with the white space after it). A unit ends a phrase if a hash of it and the two before it says so (one in
PHRASE), a rarer one of these ends a block (one in BLOCK), as a line end does; a blank line ends a section. A run of MOST_UNITS units without an end of a phrase gets one, of MOST_BLOCK units without an end of a block likewise. So
where a text is cut depends on what stands there, not on its length or on what stands far off, and no character is lost. Leaves are SHA-1 of phrases, inner nodes SHA-1 of their children's digests, the root SHA-256 of the sections'.

A fingerprint is the root, a colon, and the tree below it: sections joined by ``/``, each its key, ``=`` and its blocks joined by ``;``, each its key and, of the first LISTED blocks of a section, ``-`` and its leaves
joined by ``,``. A key is eight hex digits, a dot and the number of leaves below; a leaf is eight hex digits. So a long text takes about a twentieth of its length, and what is listed of a node does not change what it is compared by.
Equal roots mean equal texts. Unequal ones are compared from the top: branches that are equal count whole, and only those that differ are descended, which locates the edits; a block without listed leaves counts as a whole.

Defined cases: null and empty texts have one empty leaf; texts of any length are taken whole; ids are integers (others are cast, and null if they are none); rows that repeat are
neighbours in the order of ids (ties by a hash of the text); a single document is its own next one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT_CHARS = 64
UNIT = r"[^\s\p{IsIdeographic}]{1,24}\s*|\p{IsIdeographic}\s*|\s+"
#: Of how many units one ends a phrase, and a block (a multiple); and the most units of each.
PHRASE, BLOCK, MOST_UNITS, MOST_BLOCK = 3, 48, 6, 64
#: Blocks of a section whose leaves are listed.
LISTED = 256


def tree(text: Column) -> Column:
    """ARRAY (sections) OF ARRAY (blocks) OF ARRAY (phrases) of SHA-1."""
    given = F.coalesce(text, F.lit(""))
    # the characters that mark ends, where a text has them itself
    plain = F.replace(F.replace(F.replace(F.replace(given, F.lit("\0"), F.lit("\0z")), F.lit("\1"), F.lit("\0a")), F.lit("\2"), F.lit("\0b")), F.lit("\3"), F.lit("\0c"))
    given = F.when(F.rlike(given, F.lit("[\\x00-\\x03]")), plain).otherwise(given)

    def mark(u: Column, before: Column, second: Column) -> Column:
        h = F.pmod(F.xxhash64(second, before, u), F.lit(BLOCK))
        return F.when(F.contains(u, F.lit("\n\n")), "3").when(F.contains(u, F.lit("\n")) | (h == 0), "2").when(h % PHRASE == 0, "1").otherwise("0")

    def ends(units: Column) -> Column:
        marks = F.array_join(F.transform(units, lambda u, i: mark(u, F.get(units, i - 1), F.get(units, i - 2))), "")
        marks = F.concat(F.left(marks, F.length(marks) - 1), F.lit("0"))  # the end of a text needs no mark
        marks = F.regexp_replace(marks, f"(0{{{MOST_UNITS - 1}}})0(?=.)", "$11")
        return F.regexp_replace(marks, f"([01]{{{MOST_BLOCK - 1}}})[01](?=.)", "$12")

    def marked(units: Column) -> Column:
        return F.array_join(F.zip_with(units, F.split(ends(units), ""), lambda u, m: F.concat(u, F.translate(F.coalesce(m, F.lit("0")), "1230", "\1\2\3"))), "")

    whole = F.transform(F.array(F.regexp_extract_all(given, F.lit(UNIT), F.lit(0))), marked)[0]
    phrases = lambda b: F.transform(F.split(b, "\1"), lambda x: F.sha1(x))
    return F.transform(F.split(whole, "\3"), lambda s: F.transform(F.split(s, "\2"), phrases))


def fingerprint(tree_: Column) -> Column:
    node = lambda children: F.sha1(F.array_join(children, ""))
    short = lambda digest: F.left(digest, F.lit(8))
    key = lambda digest, n: F.concat(short(digest), F.lit("."), n.cast("string"))
    block = lambda leaves, i: F.struct(node(leaves).alias("d"), F.size(leaves).alias("n"), F.when(i < LISTED, F.concat(F.lit("-"), F.array_join(F.transform(leaves, short), ","))).otherwise("").alias("t"))
    section = lambda bs: F.struct(
        node(F.transform(bs, lambda x: x["d"])).alias("d"), F.aggregate(bs, F.lit(0), lambda n, x: n + x["n"]).alias("n"), F.array_join(F.transform(bs, lambda x: F.concat(key(x["d"], x["n"]), x["t"])), ";").alias("t")
    )
    sections = F.transform(F.transform(tree_, lambda s: F.transform(s, block)), section)
    whole = lambda x: F.concat(key(x["d"], x["n"]), F.lit("="), x["t"])
    # one pass over the sections gives the root and the text of the tree
    both = lambda t: F.concat(F.sha2(F.array_join(F.transform(t, lambda x: x["d"]), ""), 256), F.lit(":"), F.array_join(F.transform(t, whole), "/"))
    return F.transform(F.array(sections), both)[0]


def root(fp: Column) -> Column:
    return F.substring(fp, 1, ROOT_CHARS)


def sections(fp: Column) -> Column:
    return F.split(F.substring(fp, ROOT_CHARS + 2, 2**31 - 1), "/")


def _section_key(s: Column) -> Column:
    return F.substring_index(s, "=", 1)


def _key(block: Column) -> Column:
    return F.substring_index(block, "-", 1)


def _blocks(nodes: Column) -> Column:
    """Blocks of sections."""
    return F.flatten(F.transform(nodes, lambda s: F.split(F.substring_index(s, "=", -1), ";")))


def _leaves(block: Column) -> Column:
    return F.split(F.substring_index(block, "-", -1), ",")


def _weight(keys: Column) -> Column:
    """Leaves under nodes."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda n, k: n + F.substring_index(k, ".", -1).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else below 1: twice the leaves under what both have over the leaves of each, where equal sections count whole, of the others equal blocks, of the others equal
    leaves (what repeats inside one level counts once); or the share of leaves in blocks at the same place in both, if that is more."""

    def compare(t: Column) -> Column:
        x, y = t["x"], t["y"]  # sections
        kx, ky = F.transform(x, _section_key), F.transform(y, _section_key)
        return F.struct(F.array_intersect(kx, ky).alias("s"), _weight(kx).alias("m"), _weight(ky).alias("n"), x.alias("x"), y.alias("y"))

    def parts(t: Column) -> Column:
        left = lambda side: _blocks(F.filter(t[side], lambda s: ~F.array_contains(t["s"], _section_key(s))))
        return F.struct(left("x").alias("p"), left("y").alias("q"), _blocks(t["x"]).alias("x"), _blocks(t["y"]).alias("y"), _weight(t["s"]).alias("same"), F.greatest(t["m"], t["n"]).alias("most"))

    def deeper(t: Column) -> Column:
        kp, kq = F.transform(t["p"], _key), F.transform(t["q"], _key)
        return F.struct(t["p"].alias("p"), t["q"].alias("q"), F.array_except(kp, kq).alias("kp"), F.array_except(kq, kp).alias("kq"), (t["same"] + _weight(F.array_intersect(kp, kq))).alias("same"), t["x"].alias("x"), t["y"].alias("y"), t["most"].alias("most"))

    def leaves(t: Column) -> Column:
        listed = lambda side: F.filter(t[side], lambda b: F.contains(b, F.lit("-")) & F.array_contains(t[f"k{side}"], _key(b)))
        apart = lambda side: F.struct(F.array_distinct(F.flatten(F.transform(listed(side), _leaves))).alias("u"), _weight(F.array_except(t[f"k{side}"], F.transform(listed(side), _key))).alias("w"))
        return F.struct(apart("p").alias("p"), apart("q").alias("q"), t["same"].alias("same"), t["x"].alias("x"), t["y"].alias("y"), t["most"].alias("most"))

    def share(t: Column) -> Column:
        def placed(p: Column, q: Column) -> Column:
            leafwise = F.size(F.filter(F.zip_with(_leaves(p), _leaves(q), lambda m, n: m.eqNullSafe(n)), lambda same: same)).cast("long")
            return F.when(_key(p) == _key(q), F.substring_index(_key(p), ".", -1).cast("long")).when(F.contains(p, F.lit("-")) & F.contains(q, F.lit("-")), leafwise).otherwise(F.lit(0).cast("long"))

        there = F.aggregate(F.zip_with(t["x"], t["y"], placed), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x, F.lit(0).cast("long"))) / t["most"]
        both = t["same"] + F.size(F.array_intersect(t["p"]["u"], t["q"]["u"]))
        dice = 2 * both / (2 * t["same"] + F.size(t["p"]["u"]) + t["p"]["w"] + F.size(t["q"]["u"]) + t["q"]["w"])
        return F.least(F.greatest(dice, there), F.lit(0.999999))

    start = F.array(F.struct(sections(a).alias("x"), sections(b).alias("y")))
    for step in (compare, parts, deeper, leaves, share):
        start = F.transform(start, step)
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(start[0])


def edits(a: Column, b: Column) -> Column:
    """Numbers (from 0) of blocks of b that a has nowhere: where b was edited. Empty for equal roots."""
    own = F.transform(_blocks(sections(b)), _key)
    new = F.array_except(own, F.transform(_blocks(sections(a)), _key))
    place = F.transform(own, lambda p, i: F.when(F.array_contains(new, p), i))
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.array_compact(place))


def _parted(d: DataFrame, bounds: list[int]) -> DataFrame:
    """d with part: how many of the sorted bounds are at most id (-1 for null ids), by binary search in an array, a projection a step."""
    held = F.array(*(F.lit(x).cast("long") for x in bounds)) if bounds else F.array().cast("array<bigint>")
    d = d.withColumn("part", F.lit(0))
    for k in reversed(range(len(bounds).bit_length())):
        d = d.withColumn("part", F.col("part") + F.when(F.get(held, F.col("part") + (2**k - 1)) <= F.col("id"), F.lit(2**k)).otherwise(0))
    return d.withColumn("part", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.col("part")))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **derived: Callable[[Column], Column]) -> DataFrame:
    """id, text, next_text: the text of the next row by id, after the last one the first. For each derived name=function of the text also name and next_name, worked out once a text.

    Ids are cut into ranges of about as many rows (at quantiles, so far apart ids do not matter); a window runs within each, and the last row of a range takes the first
    text of the next range that has rows. So texts are shuffled once, and only a row a range is ordered in one task.
    """
    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    ranges = min(8 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 8192)
    found = d.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("q")).first().q
    d = _parted(d, sorted(set(found or [])))  # null ids come first
    first_ids = d.groupBy("part").agg(F.min("id").alias("id"))
    every = Window.orderBy("part")
    # a row a range: its first id, and the range before it (before the first one the last)
    linked = first_ids.withColumn("back", F.coalesce(F.lag("part").over(every), F.max("part").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = d.drop("part").join(F.broadcast(linked.select(F.col("id").alias("head"), "back")), F.col("id").eqNullSafe(F.col("head")))  # at most a row a range
    heads = heads.groupBy("back").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # the first row of the next range stands after the last one of its own
    rows = d.withColumn("guest", F.lit(0)).unionByName(heads.select(F.lit(None).cast("long").alias("id"), "text", F.col("back").alias("part"), F.lit(1).alias("guest"))).repartition("part")
    rows = rows.withColumns({name: f(F.col("text")) for name, f in derived.items()})  # after the shuffle, which carries texts alone
    within = Window.partitionBy("part").orderBy("guest", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(within) for c in ("text", *derived)}).where("guest = 0")
    return rows.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *derived, *(f"next_{c}" for c in ("text", *derived)))


def edited(text: Column, following: Column) -> Column:
    """The last half (rounded down) of the code points replaced by the first as many of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(text.substr(F.lit(1), n - half), following.substr(F.lit(1), half))
