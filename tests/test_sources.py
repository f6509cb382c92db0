"""Files as they come: folders, globs, office formats, published questions."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions.retry import retried
from tessera.sources import formats, qa, registry


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


W = 'xmlns:w="http://w"'
DOCX = archive(word__document_dot_xml=f"<w:d {W}><w:p><w:r><w:t>First</w:t></w:r><w:r><w:tab/><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:d>")
PPTX = archive(ppt__slides__slide10_dot_xml="<a><p><t>Ten</t></p></a>", ppt__slides__slide2_dot_xml="<a><p><t>Two</t></p></a>")
XLSX = archive(xl__sharedStrings_dot_xml="<sst><si><t>name</t></si><si><r><t>A</t></r><r><t>da</t></r></si></sst>", xl__worksheets__sheet1_dot_xml='<w><row><c t="s"><v>0</v></c><c><v>n</v></c></row><row><c t="s"><v>1</v></c><c><v>7</v></c></row></w>')
EPUB = archive(
    **{"META-INF__container_dot_xml": '<c><rootfile full-path="OPS/b.opf"/></c>', "OPS__b_dot_opf": '<p><item id="x" href="x.html"/><item id="y" href="y.html"/><itemref idref="y"/><itemref idref="x"/></p>', "OPS__x_dot_html": "<p>end</p>", "OPS__y_dot_html": "<p>start</p>"}
)
RTF = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 Caf\'e9 \b bold\b0 \{x\}\par \u8364?5\tab end}"
CONTENT = zlib.compress(b"BT /F1 12 Tf (Hello \\(PDF\\)) Tj 0 -14 Td [(Wor) -20 (ld)] TJ ET")
PDF = b"%PDF-1.4\n1 0 obj <</Length 9 /Filter /FlateDecode>>\nstream\n" + CONTENT + b"\nendstream endobj"


@pytest.mark.parametrize(
    "extension, data, text",
    [("docx", DOCX, "First\tline\nSecond"), ("pptx", PPTX, "Two\n\nTen"), ("xlsx", XLSX, "name\tn\nAda\t7"), ("epub", EPUB, "start\n\nend"), ("rtf", RTF, "Café bold{x}\n€5\tend"), ("pdf", PDF, "Hello (PDF)\nWorld")],
)
def test_extractors(extension, data, text):
    got = formats.EXTRACTORS[extension](data)
    assert got.replace("bold ", "bold") == text


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a b+c.txt").write_text("one")
    (tmp_path / "deep" / "d.docx").write_bytes(DOCX)
    (tmp_path / "deep" / "er" / "e.md").write_text("# two")
    (tmp_path / "deep" / "er" / ".hidden.txt").write_text("hidden")
    return tmp_path


def texts(df):
    return [r.page_content for r in df.orderBy("position").collect()]


def test_folders_globs_and_missing_files(spark, tree):
    load = lambda *s: texts(registry.load(spark, [str(tree / x) for x in s]))
    everything = ["one", "First\tline\nSecond", "# two"]
    assert sorted(load("")) == sorted(everything) and sorted(load("**/*")) == sorted(everything)
    assert load("*") == ["one"] and load("*.txt", "nowhere.txt", "a b+c.txt") == ["one"]
    assert load("deep/er", "a b+c.txt") == ["# two", "one"] and load("a b+c.txt", "deep/er") == ["one", "# two"]
    assert load("deep/*/?.md") == ["# two"] and load("deep/[a-d].docx") == ["First\tline\nSecond"]
    for nothing in (["nowhere.txt"], ["*.none"]):
        with pytest.raises(ValueError, match="no sources"):
            load(*nothing)
    (tree / "f.odd").write_text("x")
    with pytest.raises(ValueError, match="no reader"):
        load("*")


def test_web_sources_by_a_fetcher(spark):
    with pytest.raises(ValueError, match="fetcher"):
        registry.load(spark, ["https://a.b/c"])
    registry.set_fetcher(lambda url: DOCX if url.endswith("docx") else f"<p>page of {url}</p>".encode())
    try:
        urls = ["https://a.b/x.docx", "https://a.b/c", "https://arxiv.org/abs/1"]
        assert texts(registry.load(spark, urls)) == ["First\tline\nSecond", "page of https://a.b/c", "page of https://arxiv.org/abs/1"]
    finally:
        registry.set_fetcher(None)


def test_tries_again():
    calls = []

    def fails(n):
        calls.append(n)
        if len(calls) < n:
            raise ConnectionError("down")
        return "up"

    assert retried(fails, wait=0)(3) == "up" and len(calls) == 3
    calls.clear()
    with pytest.raises(ConnectionError):
        retried(fails, wait=0)(9)
    assert len(calls) == 3


def test_published_questions(spark, tmp_path):
    rows = [{"question": "q", "answer": "a", "type": "Bridge_Comparison", "supporting_facts": [["Lake", 0], ["Hill", 1]], "context": [["Lake", ["A lake.", 'It is "blue".']], ["Hill", ["A hill."]]]}, {"question": "r", "answer": "b", "supporting_facts": [], "context": []}]
    (tmp_path / "qa.json").write_text(json.dumps(rows))
    q = qa.read(spark, str(tmp_path / "qa.json"))
    assert sorted((r.title, r.text) for r in qa.corpus(q).collect()) == [("Hill", "A hill."), ("Lake", 'A lake.\nIt is "blue".')]
    assert [r.type for r in q.orderBy("query_id").collect()] == ["bridge_comparison", "unknown"]
    assert [r.question for r in qa.multihop(q).collect()] == ["q"] and sorted(r.id for r in qa.truth(q).collect()) == ["Hill", "Lake"]


def test_documents_inside_documents(spark):
    df = spark.sql("SELECT named_struct('page_content', 'inner', 'metadata', map('a', '2', 'b', '3')) AS page_content, map('a', '1', 'c', '4') AS metadata, 7L AS vec_id")
    (row,) = registry.as_documents(df).collect()
    assert row.page_content == "inner" and row.metadata == {"a": "2", "b": "3", "c": "4"}
    assert registry.projected(registry.as_documents(df), False).columns == ["vec_id", "page_content"]
    with pytest.raises(TypeError):
        registry.as_documents(df.select("vec_id"))
    urls = spark.createDataFrame([("https://a.b",), ("/x.txt",)], "source string")
    assert [r.source for r in registry.cached_sources(urls).collect()] == ["https://a.b"]
    assert registry.web_results(spark.createDataFrame([("t", "https://youtube.com/x", "b"), ("t", "https://a", "b")], "title string, href string, body string")).select(F.col("link")).collect()[0][0] == "https://a"
