import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import repeats

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(rows, least=200):
    """rows: (doc_id, text)."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(t[p : p + least] for _, t in rows for p in range(len(t) - least + 1))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if n[t[p : p + least]] > 1:
                gone[p : p + least] = b"\1" * least
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_against_plain_python(query, texts):
    expected = plain(list(texts.items()))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in query("op13_suffix_array_dedup")), key=str) == expected
    assert any(0 < x[2] < x[1] for x in expected)


@pytest.mark.parametrize("seed", range(6))
def test_intervals_find_what_counting_finds(seed):
    rnd = random.Random(seed)
    least = rnd.choice([2, 5, 20, 200])
    alphabet = [b"a", b"ab", bytes(range(256)), b"\0\xff"][seed % 4]
    base = bytes(rnd.choice(alphabet) for _ in range(rnd.choice([300, 3000])))
    strings = []
    for _ in range(rnd.randrange(2, 25)):
        p = rnd.randrange(len(base))
        part = bytearray(base[p : p + rnd.randrange(1, 700)])
        if part and rnd.random() < 0.5:
            part[rnd.randrange(len(part))] = rnd.choice(alphabet)
        strings.append(bytes(part))
    n = Counter(s[p : p + least] for s in strings for p in range(len(s) - least + 1))
    ends = np.cumsum([len(s) for s in strings])
    expected = [int(e) - len(s) + p for s, e in zip(strings, ends, strict=True) for p in range(len(s) - least + 1) if n[s[p : p + least]] > 1]
    assert repeats.shared_starts(np.frombuffer(b"".join(strings), np.uint8), ends, least).tolist() == expected


def made_up(rnd, least):
    words = ["ab", "ba", "a", "c", "é", "中", "\n", " "]
    phrase = lambda n: "".join(rnd.choice(words) for _ in range(n))
    common = [phrase(least), phrase(2 * least), "x" * (2 * least), "xy" * least]
    texts = []
    for _ in range(80):
        text = phrase(rnd.randrange(3 * least)) + rnd.choice(common)[rnd.randrange(least) :] + phrase(rnd.randrange(least))
        texts += [text] * rnd.choice([1, 1, 1, 3])
    return [*texts, None, "", " ", "x", "x" * (least - 1), "x" * least, common[1]]


@pytest.mark.parametrize("least,hot", [(8, 4096), (12, 3), (40, 2), (200, 1)])
def test_made_up_texts_and_hot_anchors(spark, monkeypatch, least, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BLOCK", 2000)
    rows = list(enumerate(made_up(random.Random(least), least)))
    df = spark.createDataFrame([(*r, "k", 1, "t", b"x") for r in rows], "doc_id bigint, text string, key string, p int, t string, body binary").repartition(5)
    assert got(repeats.remove(df, least)) == plain(rows, least)


def test_a_passage_in_many_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 50)
    rnd = random.Random(1)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = noise(450)
    rows = [(i, noise(rnd.randrange(100)) + passage + noise(rnd.randrange(400))) for i in range(300)]
    assert got(repeats.remove(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6))) == plain(rows)


def test_long_texts_are_hashed_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 5000)
    import tessera.llm.words as words

    monkeypatch.setattr(words, "SLICE_BYTES", 4000)
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcd") for _ in range(23_000))
    rows = [(0, long), (1, long[4_700:5_400] + "-" + long[9_000:9_300]), (2, long[:199]), (3, long[-200:]), (None, long[10_000:21_000])]
    assert got(repeats.remove(spark.createDataFrame(rows, "doc_id bigint, text string"))) == plain(rows)


def test_edges(edge, empty):
    assert repeats.remove(empty).count() == 0
    short = edge.withColumn("text", F.substring("text", 1, 4000))
    assert got(repeats.remove(short)) == plain([(r.doc_id, r.text) for r in short.collect()])
    rows = {r.doc_id: r for r in repeats.remove(edge.where("doc_id in (8, 9)")).collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.spans) for r in (rows[8], rows[9])] == [(300_000, 300_000, 1, [0, 300_000]), (100_000, 100_000, 1, [0, 100_000])]


def test_spans_merge():
    assert repeats.spans([(5, 6), (0, 2), (0, 1), (300, 301)], 200) == [(0, 205), (300, 500)]
    assert repeats.spans([(0, 1), (200, 201)], 200) == [(0, 400)]


def test_query_against_sql(query, folder):
    import duckdb
    from tessera.llm import queries

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        rows = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op13_suffix_array_dedup']})").fetchall()
    assert sorted(rows, key=str) == sorted((tuple(r[c] for c in COLUMNS) for r in query("op13_suffix_array_dedup")), key=str)
