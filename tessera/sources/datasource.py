"""``spark.read.format("tessera").load(folder)``: the files of mixed folders as documents, listed and read where the tasks are.

Options: path (what load is given) or paths (a JSON list); extensions (comma-separated) and under (the beginning of a file's address), which leave files unopened that do not match. Schema: source, extension, position (of a
document in its file), page_content. A partition is an entry of a root folder; what is beneath it is listed by the task that reads it. Hidden files, and files whose extension no reader knows, are left out.
Needs ``register(spark)`` once a session. Filters are options, not pushed down: Spark 4.1 keeps the filters of one query with the table, and a later query on the same DataFrame would miss rows.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.formats import EXTRACTORS
from tessera.sources.registry import html_text

SCHEMA = "source string, extension string, position bigint, page_content string"
Reader = Callable[[io.BufferedIOBase], Iterator[str]]


def _text(data: io.BufferedIOBase) -> Iterator[str]:
    yield data.read().decode("utf-8", "replace")


def _html(data: io.BufferedIOBase) -> Iterator[str]:
    yield html_text(data.read().decode("utf-8", "replace"))


def _xml(data: io.BufferedIOBase) -> Iterator[str]:
    yield re.sub("<[^>]*>", " ", data.read().decode("utf-8", "replace")).strip(" ")


def _lines(data: io.BufferedIOBase) -> Iterator[str]:
    for line in io.TextIOWrapper(data, "utf-8", "replace"):
        yield line.rstrip("\r\n")


def _csv(data: io.BufferedIOBase) -> Iterator[str]:
    rows = csv.reader(io.TextIOWrapper(data, "utf-8", "replace", newline=""))
    header = next(rows, [])
    for row in rows:
        if row:
            yield "\n".join(f"{name}: {value}" for name, value in zip(header, [*row, *[""] * len(header)], strict=False))


def _extracted(extract: Callable[[bytes], str]) -> Reader:
    def run(data: io.BufferedIOBase) -> Iterator[str]:
        yield extract(data.read())

    return run


READERS: dict[str, Reader] = {"txt": _text, "md": _text, "yaml": _text, "json": _text, "html": _html, "xml": _xml, "jsonl": _lines, "csv": _csv} | {k: _extracted(f) for k, f in EXTRACTORS.items()}


@dataclass
class Entry(InputPartition):
    """A file, or a folder with all that is beneath it."""

    path: str


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def _hidden(path: str) -> bool:
    return path.rsplit("/", 1)[-1][:1] in ("", ".", "_")


class Documents(DataSourceReader):
    def __init__(self, roots: list[str], extensions: set[str] | None = None, under: str = ""):
        self.roots, self.extensions, self.under = roots, set(READERS) if extensions is None else extensions & set(READERS), under

    def partitions(self) -> list[Entry]:
        from pyarrow import fs

        out = []
        for root in self.roots:
            store, path = _store(root)
            info = store.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(root)
            scheme = root[: root.index(path)] if root.endswith(path) and root != path else ""
            entries = [path] if info.type == fs.FileType.File else [f.path for f in store.get_file_info(fs.FileSelector(path)) if not _hidden(f.path)]
            out += [Entry(scheme + e) for e in sorted(entries)]
        return out or [Entry("")]

    def read(self, partition: Entry) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.path:
            return
        store, path = _store(partition.path)
        scheme = partition.path[: len(partition.path) - len(path)]
        todo = [path]
        while todo:
            now = todo.pop()
            info = store.get_file_info(now)
            if info.type == fs.FileType.Directory:
                todo += sorted((f.path for f in store.get_file_info(fs.FileSelector(now)) if not _hidden(f.path)), reverse=True)
                continue
            suffix = re.search(r"[^/.]\.([A-Za-z0-9]+)$", now)
            extension = suffix[1].lower() if suffix else ""
            if extension in self.extensions and (scheme + now).startswith(self.under):
                with store.open_input_stream(now) as data:
                    for position, text in enumerate(READERS[extension](data)):
                        yield scheme + now, extension, position, text


class TesseraSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        roots = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        given = self.options.get("extensions")
        return Documents([r.rstrip("/") or "/" for r in roots], {e.strip().lstrip(".").lower() for e in given.split(",")} if given else None, self.options.get("under", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TesseraSource)
