import random
import re
from collections import Counter

import numpy as np
import pytest
from tessera.llm import phrases, sketch

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=30, longest=4, top=2000):
    """rows: (lang, text)."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                own.update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        often = {p: a for p, a in own.items() if " " in p and a >= least}
        inside = Counter()
        for p, a in often.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    q = " ".join(w[i : i + k])
                    inside[q] = max(inside[q], a)
        scored = []
        for p, a in often.items():
            w = p.split(" ")
            cuts = [(own[" ".join(w[:k])], own[" ".join(w[k:])], k) for k in range(1, len(w))]
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for x, y, k in cuts)
            if 100 * inside[p] < 80 * a:
                scored.append((-score, -a, p.encode(), p, a, left, right, score))
        out += [(lang, i + 1, p, a, x, y, totals[lang], s) for i, (*_, p, a, x, y, s) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_against_plain_python(query, spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text").collect()
    expected = plain([tuple(d) for d in docs])
    assert len(expected) > 20 and sorted(tuple(r[c] for c in COLUMNS) for r in query("op11_phrase_collocations")) == expected


@pytest.mark.parametrize("least,top", [(2, 7), (3, 2000), (5, 50)])
def test_made_up_texts(spark, monkeypatch, least, top):
    monkeypatch.setattr(sketch, "LEAST_CELLS", 1 << 18)
    rnd = random.Random(least)
    vocabulary = ["a", "B", "c", "dd", "É", "中", "e.", "f,", "g\n", "h\t", "i\u00a0j", "k!", "😀", "-"]
    rows = [(rnd.choice([None, "und", "en", "", "fr"]), "".join(rnd.choice(vocabulary) + rnd.choice([" ", "  ", "\t"]) for _ in range(rnd.randrange(60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, " \t\n.,"), ("only", "one"), ("hot", "x y z w " * 4000)]
    df = spark.createDataFrame([(*r, 1, "k", 2.0, 3) for r in rows], "lang string, text string, n int, phrase string, score double, words int").repartition(5)
    assert got(phrases.collocations(df, least=least, top=top)) == plain(rows, least, top=top)


def test_long_texts_are_cut_between_pieces(spark):
    text = ("the quick brown fox, jumps over the lazy dog; " * 20_000)[:-3]
    rows = [("en", text), ("en", text.replace(",", "").replace(";", "")[:900_000])]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(phrases.collocations(df)) == plain(rows)


def test_a_full_sketch_loses_nothing(spark, monkeypatch, folder):
    monkeypatch.setattr(sketch, "width_for", lambda n: 1 << 18)
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 5_000)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text")
    assert got(phrases.collocations(docs, least=4, top=None).selectExpr("lang", "0L AS rank", "phrase", "a", "l", "r", "n", "score")) == sorted((x[0], 0, *x[2:]) for x in plain([tuple(d) for d in docs.collect()], 4, top=10**9))


def test_sketches_never_undercount():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    hashes = np.repeat(values, rng.integers(1, 60, 3000))
    rng.shuffle(hashes)
    width, least = 1 << 18, 30
    total = np.zeros(sketch.DEPTH * width, np.int64)
    for part in np.array_split(hashes, 7):
        batch = sketch.partial(part, width, least)
        for shard, gaps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = sketch._places(np.frombuffer(gaps, np.uint8))
            total[shard * sketch.SHARD + at] += np.frombuffer(counts, np.uint8)
    true = dict(zip(*np.unique(hashes, return_counts=True), strict=True))
    for row in range(sketch.DEPTH):
        found = total[sketch.cells(values, row, width)]
        assert all(f >= min(true[v], least) for f, v in zip(found.tolist(), values, strict=True))
    at = np.array([0, 254, 255, 256, 600, 131_000])
    assert sketch._places(sketch._gaps(at)).tolist() == at.tolist()
    assert sketch.partial(np.zeros(0, np.uint64), width, least).num_rows == 0


def test_edges(edge, empty):
    from pyspark.sql import functions as F

    assert phrases.collocations(empty.withColumn("lang", F.col("source"))).count() == 0
    d = edge.withColumn("lang", F.col("source"))
    assert got(phrases.collocations(d, least=2)) == plain([(r.lang, r.text) for r in d.collect()], 2)


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**17
    r = spark.sql(f"SELECT (cast(2000000 as decimal(10,0)) * cast({big} as decimal(19,0))) div (cast({big} as decimal(19,0)) + cast({big + 7} as decimal(19,0))) AS score").first()
    assert r.score == 2_000_000 * big // (2 * big + 7)


def test_query_against_sql(query, folder):
    import duckdb
    from tessera.llm import queries

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        rows = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op11_phrase_collocations']})").fetchall()
    assert sorted(rows, key=str) == sorted((tuple(r[c] for c in COLUMNS) for r in query("op11_phrase_collocations")), key=str)
