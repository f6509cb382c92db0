import pytest

#: Nulls, empty and very long texts, repeated rows, and columns named as the operators' own.
EDGE = [
    (0, None, None), (1, "", "s"), (2, "   \n\t ", "s"), (3, "word", "s"), (4, "one two three four", None), (5, "a b c d e f g h i j", "t"), (6, "a b c d e f g h i j", "t"), (7, "A b C d e f g h i j k", "t"),
    (8, "very long " * 30_000, "u"), (9, "x" * 100_000, "u"), (10, "naïve café ünïcode 中文 😀 text", "u"), (10, "naïve café ünïcode 中文 😀 text", "u"), (11, "line\nline\n\nline\n \nother", None),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, s, "x", 1, "k", 2.0) for i, t, s in EDGE]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, id string, n_words int, label string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def query(spark, folder):
    """Rows of a registered query over the smallest tables, each run once."""
    from tessera.llm import queries

    made, kept = queries.queries(), {}

    def run(name):
        if name not in kept:
            kept[name] = made[name](spark, folder).collect()
        return kept[name]

    return run
