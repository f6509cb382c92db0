from collections import defaultdict

import pytest
from brute import WORD
from tessera.llm import mixing


def test_query_meets_its_targets(query, spark, folder, texts):
    rows = query("op3_source_mixing")
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        total[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(total.values()))
    for s in total:
        assert target[s] <= 2 * total[s] + 1e-6 and abs(taken[s] - target[s]) <= max(30, 0.03 * target[s])
    assert all(r.source_size == total[source[r.doc_id]] for r in rows)


def test_targets_are_reshared():
    assert mixing.targets({"a": 10, "b": 100, None: 100}) == pytest.approx({"a": 20, "b": 295 * 2 / 3 if 295 * 2 / 3 <= 200 else 200, None: 295 / 3})
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, "b": 4}) == {"a": 0.0, "b": 6.0}


def test_reruns_agree_and_no_size_sits_in_one_bucket(spark, query, folder):
    again = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet").repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in query("op3_source_mixing")}


def test_rates_are_tilted_exponentially(query):
    """Within a source the odds of a rate are linear in size."""
    import math

    by = defaultdict(set)
    for r in query("op3_source_mixing"):
        if 0.01 < r.rate < 1.99:
            by[r.source].add((r.size, math.log(r.rate / (2 - r.rate))))
    for rows in by.values():
        (a, x), *rest = sorted(rows)
        slopes = [(y - x) / (b - a) for b, y in rest if b > a]
        assert all(s == pytest.approx(slopes[0], rel=1e-6, abs=1e-12) for s in slopes)


def test_edges(edge, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == edge.count() and all(r.taken == 0 for r in got if not r.size) and mixing.mix(empty).count() == 0
    assert {r.source for r in got} == {None, "s", "t", "u"}
    assert mixing.repeat(edge).columns == edge.columns and mixing.repeat(empty).count() == 0
    with pytest.MonkeyPatch.context() as m, pytest.raises(ValueError, match="sources"):
        m.setattr(mixing, "MAX_SOURCES", 1)
        mixing.mix(edge)


def test_tilts_against_bisection(query):
    """An independent solver: the tilt of each source by bisection over its documents, in plain floats."""
    import math

    by = defaultdict(list)
    for r in query("op3_source_mixing"):
        by[r.source].append(r)
    for rows in by.values():
        total, target = rows[0].source_size, rows[0].target
        mean = max(total / len(rows), 1e-9)
        rate = lambda tilt, size: 2 / (1 + math.exp(-max(-700.0, min(700.0, tilt * size / mean))))
        if target >= 2 * total * (1 - mixing.NEAR):
            assert all(r.rate == 2 for r in rows if r.size)
            continue
        low, high = -1000.0, 1000.0
        for _ in range(200):
            tilt = (low + high) / 2
            low, high = (tilt, high) if sum(r.size * rate(tilt, r.size) for r in rows) < target else (low, tilt)
        assert all(r.rate == pytest.approx(rate(tilt, r.size), abs=1e-6) for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)
