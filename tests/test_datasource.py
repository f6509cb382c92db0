import json

import pytest
from tessera.sources import datasource, registry


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "one.txt").write_text("plain text")
    (tmp_path / "a/two.md").write_text("# head")
    (tmp_path / "a/b/three.html").write_text("<p>shown</p><script>not</script>")
    (tmp_path / "a/b/c/four.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "a/b/five.csv").write_text('n,t\n1,"two, three"\n2,\n')
    (tmp_path / "a/six.xml").write_text("<r><v>seven</v></r>")
    (tmp_path / "a/b/_skip.txt").write_text("no")
    (tmp_path / ".hidden/no.txt").write_text("no")
    (tmp_path / "a/image.bin").write_bytes(b"\0")
    (tmp_path / "empty").mkdir()
    return tmp_path


def test_mixed_folders_read_as_the_registry_reads_them(spark, folder):
    datasource.register(spark)
    got = spark.read.format("tessera").load(str(folder))
    assert got.columns == ["source", "extension", "position", "page_content"]
    rows = [(r.source.rsplit("/", 1)[1], r.page_content) for r in got.collect()]
    files = [str(folder / f) for f in ("one.txt", "a/two.md", "a/b/three.html", "a/b/c/four.jsonl", "a/b/five.csv", "a/six.xml")]
    want = [(r.source.rsplit("/", 1)[1], r.page_content) for r in registry.load(spark, files).collect()]
    assert sorted(rows) == sorted(want) and len(rows) == 8
    both = spark.read.format("tessera").option("paths", json.dumps([str(folder / "a/b/c"), f"file://{folder}/one.txt"])).load()
    assert sorted((r.position, r.page_content) for r in both.collect()) == [(0, "plain text"), (0, '{"x": 1}'), (1, '{"x": 2}')]
    assert spark.read.format("tessera").load(str(folder / "empty")).count() == 0
    with pytest.raises(Exception, match="not there"):
        spark.read.format("tessera").load(str(folder / "not there")).count()


def test_options_leave_files_unopened(spark, folder):
    datasource.register(spark)
    (folder / "a/broken.docx").write_bytes(b"not a zip file")
    read = spark.read.format("tessera")
    df = read.load(str(folder))
    with pytest.raises(Exception, match="zip"):
        df.count()
    assert {r.extension for r in read.option("extensions", "txt, .MD").load(str(folder)).collect()} == {"txt", "md"}
    assert spark.read.format("tessera").option("under", f"{folder}/a/b/c").load(str(folder)).count() == 2
    (folder / "a/broken.docx").unlink()
    assert (df.where("extension = 'csv'").count(), df.count()) == (2, 8)  # filters of one query do not stay for the next


def test_a_partition_is_an_entry_and_lists_itself(folder):
    r = datasource.Documents([str(folder)])
    assert [p.path.rsplit("/", 1)[1] for p in r.partitions()] == ["a", "empty", "one.txt"]
    assert len(list(r.read(datasource.Entry(str(folder / "a"))))) == 7
