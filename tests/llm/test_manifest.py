import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tessera.llm import manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Root and, for each leaf, its siblings as (is left, digest) or None, lowest first."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            paths[i].append((k % 2 == 1, level[k ^ 1]) if k ^ 1 < len(level) else None)
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], paths


def plain(rows, tampered):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees.append((own, *plain_tree([plain_leaf(*r) for r in own])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for r, way in zip(own, paths, strict=True):
            way = way + top
            seen = (*r[:3], r[3] + 1, r[4]) if tampered(r[0]) and r[3] is not None else r
            folded = plain_leaf(*seen)
            for step in way:
                folded = sha(folded) if step is None else sha(step[1], folded) if step[0] else sha(folded, step[1])
            out.append((r[0], plain_leaf(*r), subroot, root, sha(*(s[1] for s in way if s)), folded, folded == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def marked(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 0


def changed(c):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return F.when(hit, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c)


def test_query_against_plain_python(query, spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*manifest.FIELDS).collect()
    rows = sorted((tuple(r[c] for c in COLUMNS) for r in query("op12_merkle_dataset_manifest")), key=str)
    assert rows == sorted(plain([tuple(d) for d in docs], marked), key=str)
    assert 0 < sum(not r[-1] for r in rows) < len(rows)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_supersteps_of_any_height(spark, levels):
    langs = [None, "", "a", "b", "é", "z" * 40]
    rows = [(i, f"s{i % 3}", langs[(i * i) % 7 % 6], None if i % 5 == 0 else i, f"text {i % 11}") for i in range(-20, 57)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert got(manifest.manifest(df, changed, levels)) == sorted(plain(rows, marked), key=str)


def test_edges(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, place bigint, tree string, id string, total int"
    assert manifest.manifest(spark.createDataFrame([], schema)).count() == 0
    one = [(7, None, None, None, None)]
    assert got(manifest.manifest(spark.createDataFrame([(*one[0], "x", 1, "t", "i", 2)], schema), changed)) == plain(one, marked)
    rows = [(None, "s", "en", 1, "x"), (None, "s", "en", 1, "x"), (3, "s", "en", 1, "y" * 300_000), (3, "s", "en", 2, ""), (3, None, None, None, None), (10**15, "é", "en", 5, "中😀")]
    df = spark.createDataFrame([(*r, "x", 1, "t", "i", 2) for r in rows], schema)
    assert got(manifest.manifest(df, changed)) == sorted(plain(rows, marked), key=str)


def test_equal_rows_are_spread_and_all_kept(spark):
    rows = [(1, "s", "en", 1, "x")] * 3000 + [(2, "s", "fr", 1, "x")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(7)
    assert got(manifest.manifest(df, levels=4)) == sorted(plain(rows, lambda i: False), key=str)


def test_what_was_changed_is_found(spark):
    rows = [(i, "s", "en", i, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    other = manifest.manifest(df, lambda c: F.when(F.col("doc_id") == 11, F.lit("y")).otherwise(F.col(c)) if c == "text" else F.col(c))
    assert [r.doc_id for r in other.where("not verified").collect()] == [11]


def test_a_missing_child_stops_the_step():
    step = manifest._forward(2)
    assert step((("=en", 1), [(5, 6, "b" * 64), (4, 6, "a" * 64)])) == ("=en", 1, 2, sha(sha("a" * 64, "b" * 64)))
    with pytest.raises(ValueError, match="children"):
        step((("=en", 0), [(0, 6, "a" * 64), (1, 6, "b" * 64), (3, 6, "c" * 64)]))


def test_query_against_sql(query, folder):
    import duckdb
    from tessera.llm import queries

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        rows = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op12_merkle_dataset_manifest']})").fetchall()
    assert sorted(rows, key=str) == sorted((tuple(r[c] for c in COLUMNS) for r in query("op12_merkle_dataset_manifest")), key=str)
