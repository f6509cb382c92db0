import hashlib

import pytest
from pyspark.sql import functions as F
from tessera.llm import merkle


def test_query_against_plain_python(query, texts):
    rows = {r.doc_id: r for r in query("op8_document_fingerprints")}
    ids = sorted(texts)
    assert sorted(rows) == ids
    prints = {}
    for n, i in enumerate(ids):
        own, following = texts[i] or "", texts[ids[(n + 1) % len(ids)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1) == (own == following)
        assert r.near_edited == pytest.approx(plain_likeness(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(plain_likeness(r.fingerprint, rows[ids[(n + 1) % len(ids)]].fingerprint))
    assert len(set(prints.values())) == len(prints)
    long = [r for r in rows.values() if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.97 * len(long)
    assert sum(0.2 < r.near_edited for r in long) >= 0.97 * len(long)


def parsed(fp):
    """Sections of a fingerprint: key and blocks, each its key and its leaves (None if they are not listed)."""
    block = lambda b: (b.split("-")[0], b.split("-")[1].split(",") if "-" in b else None)
    return [(s.split("=")[0], [block(b) for b in s.split("=")[1].split(";")]) for s in fp[65:].split("/")]


def plain_likeness(a, b):
    """By descent: sets of equal sections, then of equal blocks of the others, then of equal leaves of the others; or blocks at the same place."""
    if a[:64] == b[:64]:
        return 1.0
    x, y = parsed(a), parsed(b)
    n = lambda keys: sum(int(k.split(".")[1]) for k in keys)
    sections = {k for k, _ in x} & {k for k, _ in y}
    p, q = ([c for k, bs in t if k not in sections for c in bs] for t in (x, y))
    blocks = {k for k, _ in p} & {k for k, _ in q}
    same = n(sections) + n(blocks)
    sides = []
    for t in (p, q):
        listed = {k: ls for k, ls in t if k not in blocks and ls is not None}
        sides.append(({leaf for ls in listed.values() for leaf in ls}, n({k for k, _ in t} - blocks - set(listed))))
    (u, w), (v, z) = sides
    there = 0
    for (k, ls), (m, ms) in zip([c for _, bs in x for c in bs], [c for _, bs in y for c in bs]):
        there += n([k]) if k == m else sum(i == j for i, j in zip(ls, ms)) if ls is not None and ms is not None else 0
    there /= max(n(k for k, _ in x), n(k for k, _ in y))
    return min(0.999999, max(there, 2 * (same + len(u & v)) / (2 * same + len(u) + w + len(v) + z)))


def fp(c):
    return merkle.fingerprint(merkle.tree(F.col(c)))


def test_likeness_descends(spark):
    a = "one. two.\nthree. four.\n\nfive. six.\n\nseven"
    texts = [a, a.replace("four", "4"), "five. six.\n\n" + a, "other", "", a + " x", "three. four.\nseven", "a \0\1b \2c", "a \0a\0b \3c"]
    d = spark.createDataFrame([(x, y) for x in texts for y in texts], "a string, b string")
    for r in d.select("a", "b", fp("a").alias("x"), fp("b").alias("y"), merkle.likeness(fp("a"), fp("b")).alias("near")).collect():
        assert r.near == pytest.approx(plain_likeness(r.x, r.y)) and (r.near == 1) == (r.a == r.b)


def prose(n, seed=2):
    import random

    rnd = random.Random(seed)
    words = "the olive grove above a bay and other acres before dawn ".split() + [f"w{i}" for i in range(500)]
    return " ".join(rnd.choice(words) for _ in range(n // 4))[:n]


def test_very_long_texts_have_few_leaves(spark):
    words = "the olive grove above a bay and other acres before dawn ".split()
    import random

    rnd = random.Random(2)
    long = " ".join(rnd.choice(words) for _ in range(200_000))
    got = spark.createDataFrame([(long,), (long[:900_000] + "changed" + long[900_007:],)], "t string").select(fp("t").alias("f")).collect()
    assert len(got[0].f) < 0.2 * len(long) and 0.9 < plain_likeness(got[0].f, got[1].f) < 1


@pytest.mark.parametrize("size", [2_000, 60_000, 65_536, 70_000, 131_072, 524_288, 600_000])
def test_likeness_does_not_depend_on_the_length(spark, size):
    """A text and its first half with another text's words, on both sides of lengths where rules might change; and an insertion near the start."""
    a, b = prose(size), prose(size, 3)
    half, grown = a[: size // 2] + b[: size // 2], a[:500] + " some inserted words " + a[500:]
    r = spark.createDataFrame([(a, half, grown, a[: size - 500])], "a string, h string, g string, s string").select(*(merkle.likeness(fp("a"), fp(c)).alias(c) for c in "hgs")).first()
    assert abs(r.h - 0.5) < 0.06 and r.g > 0.95 and r.s > 0.7


def test_texts_of_any_script(spark):
    import random

    rnd = random.Random(7)
    han = "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(3000))
    code = "".join(rnd.choice("0123456789abcdef(){};_") for _ in range(3000))
    rows = [(t, t[:1500] + t[:1500][::-1]) for t in (han, code, "spam " * 600, "x" * 3000)]
    near = [r.n for r in spark.createDataFrame(rows, "a string, b string").select(merkle.likeness(fp("a"), fp("b")).alias("n")).collect()]
    assert all(0.35 < n < 1 for n in near[:3]) and near[3] == 1


def plain(text):
    import re

    import regex
    import xxhash

    for c, to in (("\0", "\0z"), ("\1", "\0a"), ("\2", "\0b"), ("\3", "\0c")):
        text = text.replace(c, to)

    def mark(i):
        u, h = units[i], 42
        for x in units[max(0, i - 2) : i + 1]:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        h = (h - 2**64 if h >= 2**63 else h) % merkle.BLOCK
        return "3" if "\n\n" in u else "2" if "\n" in u or h == 0 else "1" if h % merkle.PHRASE == 0 else "0"

    space = r"[ \t\n\x0B\f\r]"
    units = regex.findall(rf"[^ \t\n\x0B\f\r\p{{Ideographic}}]{{1,24}}{space}*|\p{{Ideographic}}{space}*|{space}+", text)
    marks = "".join(map(mark, range(len(units))))[:-1] + "0"
    marks = re.sub("(0{%d})0(?=.)" % (merkle.MOST_UNITS - 1), r"\g<1>1", marks)
    marks = re.sub("([01]{%d})[01](?=.)" % (merkle.MOST_BLOCK - 1), r"\g<1>2", marks)
    tree, now = [[[]]], ""
    for u, m in zip(units, marks):
        now += u
        if m != "0":
            tree[-1][-1].append(now)
            now = ""
        if m == "2":
            tree[-1].append([])
        if m == "3":
            tree.append([[]])
    tree[-1][-1].append(now)
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    return hashlib.sha256("".join(sha("".join(sha("".join(sha(x) for x in b)) for b in s)) for s in tree).encode()).hexdigest()


def test_root_is_built_from_children(spark, texts):
    given = ["Title here.\nFirst one, second two.\n\nOther section: with a phrase", "", " ", "\n\n\n", "a\0b\1c\2 \3", "中文 字符 ünï 😀 " * 50, "word " * 500, *(t or "" for t in texts.values())]
    got = {r.t: r.f for r in spark.createDataFrame([(t,) for t in given], "t string").select("t", fp("t").alias("f")).collect()}
    for t in given:
        assert got[t].split(":")[0] == plain(t), t[:50]


def test_edits_are_located(spark):
    a = "one line.\ntwo lines.\nthree lines."
    d = spark.createDataFrame([(a, "one line.\ntwo changed.\nthree lines."), (a, a), (a, a + "\nfour")], "a string, b string")
    got = [r[0] for r in d.select(merkle.edits(fp("a"), fp("b"))).collect()]
    assert got[0] == [1] and got[1] == [] and 3 in got[2]


def test_edges(edge, empty, spark):
    rows = merkle.with_next(edge).orderBy("doc_id").collect()
    assert len(rows) == edge.count() and rows[0].text == "" and rows[-1].next_text == ""
    assert [r.next_text for r in rows if r.doc_id == 3] == ["one two three four"]
    assert merkle.with_next(empty).count() == 0
    (one,) = merkle.with_next(edge.where("doc_id = 3")).collect()
    assert one.next_text == "word"
    skewed = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(2**62, "end")], "doc_id bigint, text string")
    parts = merkle.with_next(skewed)
    assert [r.next_text for r in parts.orderBy("doc_id").collect()] == [*(f"t{i}" for i in range(1, 500)), "end", "t0"]
    far = spark.createDataFrame([(-(2**62), "a"), (0, "b"), (2**62, "c"), (None, "n")], "doc_id bigint, text string")
    assert [(r.text, r.next_text) for r in merkle.with_next(far).orderBy("text").collect()] == [("a", "b"), ("b", "c"), ("c", "n"), ("n", "a")]
