"""WARC archives as a chunked record table.

Writing: each task streams its rows to archives of its own (a gzip member a record) in the shared folder, a payload in pieces of CHUNK bytes straight
from the Arrow buffer, and returns a manifest row an archive; only archives in the kept manifest count, so what a lost or repeated task leaves behind is never read.
Reading: an archive is a stream; each record becomes rows (record, chunk number, bytes), with a digest carried from chunk to chunk and given
on the last one. No side ever holds a record beyond one chunk, whatever its size (the table that is archived holds its own texts, of course).

Equal payloads of at least ``least`` bytes are stored once: the record with the smallest id is a ``response``, others are ``revisit`` records
of profile identical-payload-digest that refer to it. A revisit keeps the HTTP header, and so the length of the full payload.

Defined cases: a null payload is empty; a null URL is written as ``urn:none`` and read back as null; control characters and spaces in a URL are percent-encoded;
rows that share the smallest id of their payload are all responses; an empty table writes no archive and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.work import Work, lean, small_batches

CHUNK = 1 << 18
#: Bytes after which a task starts another archive.
ARCHIVE_BYTES = 1 << 28
DATE = "1970-01-01T00:00:00Z"
_ID = "urn:tessera:record:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class _Archive:
    """A gzip member for each record; what is given is compressed and written at once."""

    def __init__(self, fs, path: str):
        self.path, self.out, self.size, self.records = path, fs.open_output_stream(path, compression=None), 0, 0

    def record(self, fields: list[tuple[str, str]], head: bytes, payload: Iterator[memoryview]) -> None:
        press = zlib.compressobj(1, zlib.DEFLATED, 31)
        self._put(press.compress(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + head))
        for part in payload:
            self._put(press.compress(part))
        self._put(press.compress(b"\r\n\r\n") + press.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)

    def close(self) -> None:
        self.out.close()


def _parts(data: memoryview, size: int) -> Iterator[memoryview]:
    return (data[i : i + size] for i in range(0, len(data), size))


def write(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Write archives under folder (any URI that pyarrow.fs opens); returns the manifest: path, records, bytes. Run it once: keep what it returns."""
    small_batches(pages.sparkSession)
    p = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload"))
    p = p.withColumns({"digest": F.sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload").cast("long")})
    # one row a payload that occurs more than once; a frequent payload is counted before it is shuffled
    shared = p.select("id", "digest", "size").where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = p.join(shared, ["digest", "size"], "left")
    p = p.withColumn("original", F.when(F.col("original") < F.col("id"), F.col("original")))
    p = p.select("id", "url", "digest", "size", "original", F.when(F.col("original").isNull(), F.encode("payload", "UTF-8")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        store, root = pfs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root}/{context.partitionId():06d}-{context.taskAttemptId()}"
        archive, done = None, []
        for b in batches:
            column = b.column(5)
            for i, (key, url, digest, size, original) in enumerate(zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)):
                if archive is None:
                    archive = _Archive(store, f"{name}-{len(done)}.warc.gz")
                    info = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
                    archive.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{_ID}info:{context.partitionId()}-{len(done)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))], info, iter(()))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                data = memoryview(b"") if original is not None else memoryview(column[i].as_buffer())
                fields = [
                    ("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", f"<{_ID}{key}>"), ("WARC-Date", DATE), ("WARC-Target-URI", "urn:none" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
                    ("WARC-Payload-Digest", "sha1:" + base32_sha1(bytes.fromhex(digest))),
                ]
                if original is not None:
                    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_ID}{original}>")]
                fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(head) + len(data)))]
                archive.record(fields, head, _parts(data, chunk))
                if archive.size >= ARCHIVE_BYTES:
                    archive.close()
                    done.append(archive)
                    archive = None
        if archive is not None:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{a.path.rsplit('/', 1)[1]}" for a in done], pa.string()), pa.array([a.records for a in done], pa.int64()), pa.array([a.size for a in done], pa.int64())], ["path", "records", "bytes"])

    return p.mapInArrow(lean(run), "path string, records bigint, bytes bigint")


class _Stream:
    """The plain bytes of a gzip file of many members, a piece at a time."""

    def __init__(self, source, chunk: int):
        self.source, self.chunk, self.have, self.raw, self.gunzip = source, chunk, b"", b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(self.chunk)
                if not self.raw:
                    return False
            if self.gunzip.eof:
                self.gunzip = zlib.decompressobj(31)
            got = self.gunzip.decompress(self.raw, self.chunk)
            self.raw = self.gunzip.unused_data if self.gunzip.eof else self.gunzip.unconsumed_tail
            if got:
                self.have += got
                return True

    def head(self) -> dict[str, str] | None:
        """Lines up to an empty one: the first under "", then fields in lower case."""
        while (end := self.have.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.have.strip():
                    raise ValueError("an archive ends within a record")
                return None
        lines = self.have[:end].decode("utf-8", "replace").split("\r\n")
        self.have, self.head_bytes = self.have[end + 4 :], end + 4
        return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces of at most the chunk."""
        while n:
            if not self.have and not self._more():
                raise ValueError("an archive ends within a record")
            part, self.have = self.have[: min(n, self.chunk)], self.have[min(n, self.chunk) :]
            n -= len(part)
            yield part


def records(source, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, int, str | None]]:
    """(fields, chunk number, bytes, length of the full payload, SHA-1 in base 32 on the last chunk) of response and revisit records."""
    s = _Stream(source, chunk)
    while (fields := s.head()) is not None:
        if not fields[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {fields['']!r:.80}")
        n, kind = int(fields["content-length"]), fields["warc-type"]
        if kind in ("response", "revisit"):
            http = s.head()
            left, full = n - s.head_bytes, int(http["content-length"])
            sha, number, held, seen = hashlib.sha1(), 0, b"", 0
            for part in s.take(left):
                seen += len(part)
                held += part
                while len(held) > chunk:  # the last chunk waits until it is known to be the last
                    sha.update(held[:chunk])
                    yield fields, number, held[:chunk], full, None
                    held, number = held[chunk:], number + 1
            sha.update(held)
            if kind == "response":
                if seen != full or "sha1:" + base32_sha1(sha.digest()) != fields["warc-payload-digest"]:
                    raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
            yield fields, number, held, full, fields["warc-payload-digest"].removeprefix("sha1:") if kind == "revisit" else base32_sha1(sha.digest())
        else:
            for _ in s.take(n):
                pass
        if b"".join(s.take(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read(manifest: DataFrame, with_bytes: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives in the manifest: id, url, record_type, refers_to, chunk, last, bytes (null unless asked for), payload_bytes, payload_digest (null but on the last chunk)."""
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("bytes", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    key = lambda x: None if x is None else int(x.strip("<>").removeprefix(_ID))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        for b in batches:
            for path in b.column(0).to_pylist():
                store, own = pfs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(own, compression=None) as source:
                    for fields, number, data, full, digest in records(source, chunk):
                        url = fields["warc-target-uri"]
                        rows.append((key(fields["warc-record-id"]), None if url == "urn:none" else url, fields["warc-type"], key(fields.get("warc-refers-to")), number, digest is not None, data if with_bytes else None, full, digest))
                        size += len(data) * with_bytes
                        if len(rows) >= 4096 or size > 16 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(run, "id bigint, url string, record_type string, refers_to bigint, chunk bigint, last boolean, bytes binary, payload_bytes bigint, payload_digest string")


def archive(pages: DataFrame, least: int = 0, **names: str) -> DataFrame:
    """Write archives to the shared folder; returns the kept manifest."""
    work = Work(pages.sparkSession, "warc")
    return work.keep(write(pages, f"{work.root}/archives", least, **names), "manifest")
