import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F
from tessera.llm import warc


def test_query_against_plain_python(query, spark, folder):
    rows, first = {r.page_id: r for r in query("op9_warc_archive")}, {}
    pages = spark.read.parquet(f"{folder}/pages.parquet").orderBy("page_id").collect()
    assert len(rows) == len(pages)
    for p in pages:
        data = (p.html or "").encode()
        original = first.setdefault(data, p.page_id)
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if original == p.page_id else "revisit", None if original == p.page_id else original)
        assert tuple(rows[p.page_id][k] for k in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/ b\r\nX: y", "same"), (3, None, "same"), (9, "http://c", None), (4, "http://d", ""), (1, "http://e", "é\r\n\r\nWARC/1.1\r\n\r\n" * 50_000), (2, "u", "x" * 3_000_000), (7, "http://c", "same")]
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)


def test_round_trip_in_chunks(pages):
    manifest = warc.archive(pages)
    t = warc.read(manifest, chunk=10_000).collect()
    by = {}
    for r in sorted(t, key=lambda r: (r.id, r.chunk)):
        by.setdefault(r.id, []).append(r)
    for p in pages.collect():
        own = by[p.page_id]
        assert [r.chunk for r in own] == list(range(len(own))) and [r.last for r in own] == [False] * (len(own) - 1) + [True]
        assert all(len(r.bytes) <= 10_000 for r in own) and own[-1].payload_bytes == len((p.html or "").encode())
        if own[0].record_type == "response":
            assert b"".join(r.bytes for r in own).decode() == (p.html or "")
    assert {i: (own[-1].record_type, own[-1].refers_to) for i, own in by.items()} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("revisit", 3), 7: ("revisit", 3), 9: ("revisit", 4)}
    assert by[3][0].url is None and by[5][0].url == "http://a/%20b%0D%0AX:%20y"
    assert sum(r.records for r in manifest.collect()) == pages.count() + manifest.count()


def test_least_bytes(pages):
    t = warc.read(warc.archive(pages, least=5), with_bytes=False).where(F.col("last")).collect()
    assert {r.record_type for r in t} == {"response"} and all(r.bytes is None for r in t)


def test_damage_is_noticed(pages):
    path = warc.archive(pages.where("page_id = 2")).first().path.removeprefix("file://")
    data = gzip.decompress(open(path, "rb").read())
    with pytest.raises(ValueError, match="damaged"):
        list(warc.records(io.BytesIO(gzip.compress(data.replace(b"xxxx", b"xxyx", 1)))))
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records(io.BytesIO(gzip.compress(data[:-1000]))))


def test_stream_of_many_members_and_odd_chunks():
    rnd, out = random.Random(3), io.BytesIO()
    want = []
    for i in range(20):
        body = bytes(rnd.randrange(256) for _ in range(rnd.randrange(300)))
        head = f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.write(gzip.compress(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(head) + len(body)}\r\n\r\n".encode() + head + body + b"\r\n\r\n"))
        want.append((body, digest))
    for chunk in (1, 7, 64, 10_000):
        got, held = [], b""
        for _, _, data, _, digest in warc.records(io.BytesIO(out.getvalue()), chunk):
            held += data
            if digest:
                got.append((held, digest))
                held = b""
        assert got == want


def test_empty_table(pages):
    assert warc.read(warc.archive(pages.limit(0))).count() == 0
