import random

import pytest
from brute import near as brute
from pyspark.sql import functions as F
from tessera.llm import near


def test_query_against_brute_force(query, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in query("op2_ngram_jaccard_join")} == brute(texts)


@pytest.mark.parametrize("small, large, block", [(None, 64, 512), (9, 3, 4), (5, 1000, 4)])
def test_small_and_large_sets(spark, monkeypatch, small, large, block):
    """Many short texts over few words: subsets, lists, whole components and block pairs all take part."""
    rnd, words, texts = random.Random(5), "a b c d e f g h".split(), {}
    for i in range(300):
        n = rnd.choice([0, 1, 3, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 18, 25, 60])
        if i < 5 or rnd.random() < 0.5:
            texts[i] = " ".join(rnd.choice(words[:2] if n < 16 else words) for _ in range(n))
        else:
            own = texts[rnd.randrange(i)].split()
            for _ in range(rnd.randrange(3) if own else 0):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts[i] = " ".join(own)
    if small is not None:
        monkeypatch.setattr(near, "boundary", lambda histogram, scanned=4.0: small)
    monkeypatch.setattr(near, "LARGE", large)
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 16 * block)
    monkeypatch.setattr(near, "PART", block)  # with 4, lists of frequent shingles are split
    monkeypatch.setattr(near, "HEAVY", min(8, block))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near.components(df).collect()} == brute(texts)


def test_boundary_weighs_costs():
    assert near.boundary({3: 100, 500: 100}) >= 3
    assert near.boundary({14: 1000}) < 14
    assert near.needed(6, 8) == 6 and near.least_partner(8) == 6


def test_edges(spark, edge, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near.components(edge).collect()}
    by = {i: (n, c) for i, n, c in got}
    assert by[0] == by[1][:1] + (0,) and by[2] == (0, 2) and by[3] == (1, 3) and by[4] == (1, 4)
    assert by[5] == (6, 5) and by[6] == (6, 5) and by[7] == (7, 5) and by[10] == (2, 10)
    assert near.components(edge).count() == edge.count() and near.components(empty).count() == 0
    kept = near.keep_one(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11]


def test_ids_that_repeat_and_null_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text), (1, "q r s t u v"), (2, "q r s t u v"), (3, text), (None, text)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.components(df).collect()) == [(1, 2, 1), (1, 4, 1), (2, 2, 1), (3, 4, 1)]
    assert sorted(str(r.doc_id) for r in near.keep_one(df).collect()) == ["1", "None"]


def test_members_alone_in_their_part_of_a_split_list(spark, monkeypatch):
    """Shingles that many documents have and few post: their lists have more parts than members."""
    rnd = random.Random(8)
    prose = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    licences, texts = [prose(60) for _ in range(3)], {}
    for k, licence in enumerate(licences):
        for i in range(40):
            texts[100 + 100 * k + i] = " ".join(licence + prose(200))
        for i in range(2):  # mostly licence: linked with each other by its shingles alone
            texts[2 * k + i] = " ".join(licence + prose(3))
    monkeypatch.setattr(near, "PART", 1)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near.components(df).collect()} == brute(texts)


def test_no_partner_between_the_ends_is_left_out(spark):
    """Round two tests a component if any size from low to high can reach the threshold: 13 shingles, one shared, can with 15 but not with 11 or 16."""
    rows = [(n, sx, low, high) for n in (1, 2, 3) for sx in range(4, 24) for low in range(near.least_partner(sx), sx * 4 // 3 + 1) for high in range(low, sx * 4 // 3 + 1)]
    df = spark.createDataFrame(rows, "n int, sx int, low int, high int")
    kept = {tuple(r) for r in df.where(near._possible_between(F.col("n"))).collect()}
    unposted = lambda s: s - near.posted(s)
    possible = {(n, sx, low, high) for n, sx, low, high in rows if any(n + max(unposted(sx), unposted(sy)) >= near.needed(sx, sy) for sy in range(low, high + 1))}
    assert (1, 13, 11, 16) in possible and possible <= kept


def test_texts_of_one_length_under_one_id(spark):
    """Both texts of id 1 are as long; 2 is near one of them only, whichever comes first."""
    a, b = " ".join("abcdefghijklmnopqrst"), " ".join("uvwxyzuwyvxzuxwvyuzw")
    c = b[:-1] + "a"
    for first, second in ((a, b), (b, a)):
        df = spark.createDataFrame([(1, first), (1, second), (2, c)], "doc_id bigint, text string").coalesce(1)
        assert {(r.doc_id, r.component_id) for r in near.components(df).collect()} == {(1, 1), (2, 1)}


def test_passages_of_thousands_link_the_few_that_hold_little_else(spark):
    """Frequent shingles that many documents have and post, with lists split over parts."""
    rnd = random.Random(3)
    prose = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passages, texts = [prose(34) for _ in range(2)], {}
    for k, passage in enumerate(passages):
        for i in range(4500):
            texts[100 + 10_000 * k + i] = " ".join(passage + prose(12))
        for i in range(2):
            texts[2 * k + i] = " ".join(passage + prose(1))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near.components(df).collect()}
    assert [got[i] for i in range(4)] == [0, 0, 2, 2]
    assert sum(got[i] == i for i in texts) == len(texts) - 2
