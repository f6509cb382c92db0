import numpy as np
from brute import quality as brute
from tessera.llm import quality


def test_query_against_brute_force(query, texts):
    rows = query("op10_quality_rules")
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_learned_list_is_right_on_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn_from(docs, labels)
    assert 1 <= len(rules) <= quality.MOST_RULES
    judged = quality.judge(docs, labels).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r for r in judged if r.quality == 1], [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.2 * len(bad)


def test_rules_as_columns_agree_with_arrays(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rules = [(quality.Condition("symbols_a_word", True, 0.2), quality.Condition("n_words", False, 400.0)), (quality.Condition("upper_share", True, 0.5),)]
    rows = quality.stats(docs).withColumn("kept", quality.verdict(rules)).toPandas()
    x = quality.features({k: rows[k].to_numpy() for k in quality.STATS})
    failed = (rows["n_words"] < 50) | (100 * rows["n_repeat_words"] > 50 * rows["n_words"])
    want = ~(failed.to_numpy() | quality.covers(rules[0], x) | quality.covers(rules[1], x))
    assert (rows["kept"].to_numpy() == want).all()


def test_covering_finds_a_conjunction():
    rng = np.random.default_rng(0)
    n = 3000
    columns = {k: rng.integers(1, 1000, n) for k in quality.STATS}
    x = quality.features(columns)
    reject = (x["n_words"] < 300) & (x["symbols_a_word"] >= 2.0)
    rules = quality.learn(columns, reject, np.arange(n) % 3 == 0)
    hit = np.zeros(n, bool)
    for r in rules:
        hit |= quality.covers(r, x)
    assert (hit & ~reject).sum() <= 0.02 * n and (hit & reject).sum() >= 0.8 * reject.sum()
    assert quality.learn(columns, np.zeros(n, bool), np.arange(n) % 3 == 0) == []


def test_edges(spark, edge, empty, folder):
    labels = spark.createDataFrame([(3, 1), (None, 0), (5, None), (8, 0), (8, 1)], "doc_id bigint, quality int")
    got = quality.judge(edge, labels).collect()
    assert len(got) == edge.count()
    for r in got:
        t = {x.doc_id: x.text for x in edge.collect()}[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
    assert quality.judge(empty, labels).count() == 0 and quality.learn_from(edge, labels.limit(0)) == []
    assert quality.keep_good(edge, labels).columns == edge.columns
