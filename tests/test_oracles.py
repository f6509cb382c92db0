"""Each registered query of the retrieval part against its DuckDB oracle on the smallest tables."""

import hashlib
import math
import random
import re
from collections import defaultdict
from html import unescape

import duckdb
import pytest

from tessera.operators import chunking
from tessera.plans import catalog, graphs

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert ours == theirs


def read(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


def chunks_by_position(text, separators, size, overlap):
    """The splitters again, over positions in the text: cut after each strongest separator that occurs, descend into parts that are too long, join runs of short ones."""

    def spans(at, end, separators):
        found = next((s for s in separators if s in text[at:end]), None)
        if found is None or end - at <= size:
            return [(at, end)] if text[at:end].strip() else []
        weaker = separators[separators.index(found) + 1 :]
        if found == "":
            cuts = list(range(at + 1, end))
        else:
            cuts, p = [], text.find(found, at, end)
            while p >= 0:
                cuts.append(p + len(found))
                p = text.find(found, p + len(found), end)
        edges = [at, *(c for c in cuts if c < end), end]
        parts, out, k = list(zip(edges, edges[1:])), [], 0
        while k < len(parts):
            if parts[k][1] - parts[k][0] > size:
                out += spans(*parts[k], weaker) if weaker else [parts[k]]
                k += 1
                continue
            run = k
            while run < len(parts) and parts[run][1] - parts[run][0] <= size:
                run += 1
            first, own = k, []
            for j in range(k, run):  # a chunk ends before the part that would make it too long
                if parts[j][1] - parts[first][0] > size and j > first:
                    own.append((parts[first][0], parts[j][0]))
                    while first < j and (parts[j][0] - parts[first][0] > overlap or parts[j][1] - parts[first][0] > size):
                        first += 1
            out += own + [(parts[first][0], parts[run - 1][1])]
            k = run
        return out

    return [t for s, e in spans(0, len(text), separators) if (t := text[s:e].strip())]


def sections(text):
    out = []
    for line in text.split("\n"):
        if not out or re.match("#{1,6} ", line):
            out.append([])
        out[-1].append(line)
    return [t for lines in out if (t := "\n".join(lines).strip())]


def token_windows(text):
    ends = [m.end() for m in re.finditer(r"(?:[^\W_]+|[\W_])\s*", text)]
    starts = [0, *ends[:-1]]
    if not text.strip():
        return []
    return [text[starts[i] : ends[min(i + 1000, len(ends)) - 1]].strip() for i in range(0, max(1, len(ends) - 200), 800)]


@pytest.mark.parametrize("kind", ["recursive", "character", "markdown", "python", "code", "token", "header"])
def test_chunks_against_plain_versions(spark, kind):
    cut = sections if kind == "header" else token_windows if kind == "token" else lambda t: chunks_by_position(t, chunking.SEPARATORS[kind], 1000, 200)
    want = sorted((r.doc_id, i, len(c)) for r in read(spark, "documents") for i, c in enumerate(cut(r.text or "")))
    got = catalog.queries()[f"chunk_{kind}"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.chunk_index, r.n_chars) for r in got) == want
    assert all(r.chunk_id == f"{hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8]}_{r.chunk_index}_v1" for r in got)


@pytest.mark.parametrize("kind", ["recursive", "markdown", "python", "code"])
def test_splitters_on_any_text(kind):
    """Texts full of separators, small sizes: the same chunks as by positions, and the order of separators matters."""
    rnd = random.Random(kind)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "bc", " ", "\n", "\n\n", ";", "}", "{", "(", ")", "\n## ", "\nclass ", "\ndef ", "```\n"]) for _ in range(rnd.randrange(80)))
        size = rnd.choice([3, 8, 20])
        overlap = rnd.randrange(size)
        assert chunking.split_text(text, chunking.SEPARATORS[kind], size, overlap) == chunks_by_position(text, chunking.SEPARATORS[kind], size, overlap)
    assert chunking.split_text("ab(cd)ef", chunking.SEPARATORS["code"], 4, 0) == ["ab(", "cd)", "ef"]


def test_depth_first_against_recursion(spark):
    out = defaultdict(set)
    for r in graphs.edges(spark, FOLDER).collect():
        out[r.src].add(r.dst)
    want = set()
    for r in read(spark, "customer"):
        if r.c_custkey % 50 == 0:
            seen = []

            def visit(node, hop, score):
                if node not in (s[0] for s in seen):
                    seen.append((node, hop, score))
                    for other in sorted(out[node]) if hop < 2 else ():
                        visit(other, hop + 1, score * 0.7)

            visit(f"c{r.c_custkey}", 0, 1.0)
            want |= {(r.c_custkey, n, h, round(s, 6), i) for i, (n, h, s) in enumerate(seen, 1)}
    got = catalog.queries()["dfs_visits"](spark, FOLDER).collect()
    assert {(r.query_id, r.node_id, r.hop_distance, r.relevance_score, r.visit) for r in got} == want and len(got) == len(want) > 100


def test_html_text_against_patterns(spark):
    """Visible text by regular expressions alone, which do for the tables' plain markup."""

    def visible(html):
        text = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|noscript|template)\b.*?</\1\s*>", "", html or "")
        text = re.sub(r"(?i)</?(p|div|br|li|tr|h[1-6]|section|article|title)\b[^>]*>", "\n", text)
        lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in unescape(re.sub(r"<[^>]*>", "", text)).split("\n"))
        return "\n".join(x for x in lines if x)

    want = {r.page_id: len(visible(r.html)) for r in read(spark, "pages")}
    assert {r.page_id: r.n_chars for r in catalog.queries()["html_text_length"](spark, FOLDER).collect()} == want and max(want.values()) > 0


def test_hash_embeddings_against_counts(spark):
    want = {}
    for r in read(spark, "documents"):
        places = defaultdict(int)
        for w in (r.text or "").lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            places[h % 64] += 1 if h >> 32 & 1 else -1
        want[r.doc_id] = (64, 1.0 if any(places.values()) else 0.0, None)
    assert {r.doc_id: (r.dim, r.norm, r.error) for r in catalog.queries()["hash_embeddings"](spark, FOLDER).collect()} == want


#: Queries that SQL cannot express, each with a plain version here or in test_operators.
PLAIN = {f"chunk_{k}" for k in ("recursive", "character", "markdown", "python", "code", "token", "header")} | {"dfs_visits", "html_text_length", "hash_embeddings", "fuzzy_seed_nodes", "fuzzy_names"}


def test_every_query_is_compared():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == PLAIN


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
