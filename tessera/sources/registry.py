"""What a source string names, and which reader loads it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.retry import retried
from tessera.sources.formats import EXTRACTORS

Reader = Callable[[SparkSession, list[str]], DataFrame]
_readers: dict[str, Reader] = {}


def classify(source: Column) -> tuple[Column, Column]:
    """(extension, is_file) of a source string: arxiv or website for web addresses without a suffix in their path; files by their suffix."""
    web = F.regexp_like(source, F.lit("^https?://"))
    path = F.regexp_replace(F.regexp_replace(source, "[?#].*$", ""), "^https?://[^/]*", "")
    suffix = F.lower(F.regexp_extract(path, r"[^/.](\.[A-Za-z0-9]+)$", 1))
    extension = F.when(web & F.contains(source, F.lit("arxiv.org")), F.lit("arxiv")).when(web & (suffix == ""), F.lit("website")).otherwise(suffix)
    return extension, ~web


def _name(extension: str) -> str:
    return extension.lstrip(".").lower()


def register(extension: str) -> Callable[[Reader], Reader]:
    """Decorator: the reader of an extension (with or without its dot, in any case)."""

    def put(reader: Reader) -> Reader:
        _readers[_name(extension)] = reader
        return reader

    return put


def get(extension: str) -> Reader:
    try:
        return _readers[_name(extension)]
    except KeyError:
        raise ValueError(f"no reader for {extension!r}; known: {', '.join(known())}") from None


def known() -> list[str]:
    return sorted(_readers)


def clear() -> None:
    _readers.clear()


class _Text(HTMLParser):
    SKIPPED = {"script", "style", "noscript", "template"}
    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in self.SKIPPED
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.skip = max(0, self.skip - (tag in self.SKIPPED))
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def html_text(html: str | None) -> str:
    """Visible text, a line a block."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(html_text)


def _content(df: DataFrame, content: Column) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("source"), content.alias("page_content"))


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True, recursiveFileLookup=True)


@register("txt")
@register("md")
@register("yaml")
def read_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _content(_whole(spark, paths), F.col("value"))


@register("html")
def read_html(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _content(_whole(spark, paths), html_to_text("value"))


@register("json")
def read_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _content(_whole(spark, paths), F.col("value"))


@register("jsonl")
def read_json_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _content(spark.read.text(paths), F.col("value"))


@register("csv")
def read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A document a row: "column: value" lines."""
    df = spark.read.option("header", True).csv(paths)
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in df.columns))
    return _content(df, lines)


@register("xml")
def read_xml(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _content(_whole(spark, paths), F.trim(F.regexp_replace("value", "<[^>]*>", " ")))


@register("bmp")
@register("jpeg")
@register("jpg")
@register("png")
@register("tiff")
def read_image(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Images as their names and sizes; no text recognition is at hand."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return df.select(F.col("path").alias("source"), F.concat_ws(" ", F.col("path"), F.col("length").cast("string")).alias("page_content"))


Extractor = Callable[[bytes], str]
Fetcher = Callable[[str], bytes]
_fetch: list[Fetcher] = []


def register_extractor(extension: str, extract: Extractor) -> None:
    """The reader of a binary format: a function from a file's bytes to its text, run where the files are."""

    @register(extension)
    def read(spark: SparkSession, paths: list[str]) -> DataFrame:
        files = spark.read.format("binaryFile").load(paths).select("path", "content")
        return files.select(F.col("path").alias("source"), F.pandas_udf(lambda c: c.map(extract), T.StringType())("content").alias("page_content"))


def set_fetcher(fetch: Fetcher | None) -> None:
    """How the content of a web address is fetched, which this library does not do by itself: a function from the address to bytes, tried three times."""
    _fetch[:] = [fetch] if fetch else []


def read_web(spark: SparkSession, urls: list[str], extension: str) -> DataFrame:
    if not _fetch:
        raise ValueError("no fetcher for web addresses; name one by set_fetcher")
    fetch, extract = retried(_fetch[0]), EXTRACTORS.get(_name(extension), lambda data: html_text(data.decode("utf-8", "replace")))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"source": pdf["source"], "page_content": [extract(fetch(u)) for u in pdf["source"]]})

    return spark.createDataFrame([(u,) for u in urls], "source string").repartition(min(len(urls), 32)).mapInPandas(run, "source string, page_content string")


@register("arxiv")
def read_arxiv(spark: SparkSession, urls: list[str]) -> DataFrame:
    return read_web(spark, urls, "html")


@register("website")
def read_website(spark: SparkSession, urls: list[str]) -> DataFrame:
    return read_web(spark, urls, "html")


for _extension, _extract in EXTRACTORS.items():
    register_extractor(_extension, _extract)


def _pattern(glob: str) -> str:
    """A glob as a regular expression: * and ? stay within a name, ** goes over folders, names that begin with a dot match only if asked for."""
    out, parts = [], glob.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(r"(?:[^/.][^/]*/)*" + (r"[^/.][^/]*" if last else ""))
            continue
        body = "".join("[^/]*" if t == "*" else "[^/]" if t == "?" else t.replace("[!", "[^") if t.startswith("[") and len(t) > 2 else re.escape(t) for t in re.findall(r"\[[^/\]]+\]|.", part))
        out.append((r"(?!\.)" if part[:1] in ("*", "?", "[") else "") + body + ("" if last else "/"))
    return "".join(out)


def _plain(path: str) -> str:
    """A path without its scheme, as listings and readers write it differently."""
    return re.sub("^[A-Za-z0-9+.-]+:/+", "/", path)


def find(spark: SparkSession, sources: list[str]) -> list[tuple[str, str]]:
    """(address, extension) of web addresses and of all files that paths, folders (all beneath) and globs name, in order, each once; missing files are skipped."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def beneath(path: str) -> list[str]:
        place = jvm.Path(path)
        store = place.getFileSystem(conf)
        if not store.exists(place):
            return []
        if store.getFileStatus(place).isFile():
            return [store.makeQualified(place).toString()]
        found, listed = [], store.listFiles(place, True)
        while listed.hasNext():
            found.append(listed.next().getPath().toString())
        return sorted(found)

    out: dict[str, str] = {}
    for s in sources:
        if re.match("https?://", s):
            suffix = re.search(r"[^/.]\.([A-Za-z0-9]+)(?:[?#].*)?$", s.split("//", 1)[1].partition("/")[2])
            out.setdefault(s, "arxiv" if "arxiv.org" in s else suffix[1].lower() if suffix else "website")
            continue
        if re.search(r"[*?\[]", s):
            parts = s.split("/")
            fixed = next(i for i, p in enumerate(parts) if re.search(r"[*?\[]", p))
            base = "/".join(parts[:fixed]) or ("/" if s.startswith("/") else ".")
            root = _plain(jvm.Path(base).getFileSystem(conf).makeQualified(jvm.Path(base)).toString()).rstrip("/")
            wanted = re.compile(re.escape(root) + "/" + _pattern("/".join(parts[fixed:])))
            found = [f for f in beneath(base) if wanted.fullmatch(_plain(f))]
        else:
            found = [f for f in beneath(s) if not re.search(r"/[._][^/]*$", f) or _plain(f).endswith(_plain(s))]
        for f in found:
            suffix = re.search(r"[^/.]\.([A-Za-z0-9]+)$", f)
            out.setdefault(f, suffix[1].lower() if suffix else "")
    return list(out.items())


def load(spark: SparkSession, sources: list[str]) -> DataFrame:
    """position (of the source among all), source, page_content: one distributed read a format, each file by the reader of its own extension. Without any source that is there it raises, as for an extension without a reader."""
    found = find(spark, sources)
    if not found:
        raise ValueError("no sources")
    by: dict[str, list[str]] = {}
    for address, extension in found:
        by.setdefault(extension, []).append(address)
    escaped = lambda p: re.sub(r"([*?\[\]{}])", r"\\\1", p)
    parts = []
    for extension, addresses in by.items():
        web = addresses[0].startswith("http")
        if web and extension not in ("arxiv", "website"):
            parts.append(read_web(spark, addresses, extension))
        else:
            parts.append(get(extension)(spark, addresses if web else [escaped(a) for a in addresses]))
    out = reduce(DataFrame.unionByName, parts)
    places = spark.createDataFrame([(i, _plain(address)) for i, (address, _) in enumerate(found)], "position bigint, _path string")
    decoded = F.when(F.startswith("source", F.lit("file:")) | F.contains("source", F.lit("%")), F.try_url_decode(F.replace("source", F.lit("+"), F.lit("%2B")))).otherwise(F.col("source"))
    path = F.regexp_replace(F.coalesce(decoded, F.col("source")), "^(?!https?:)[A-Za-z0-9+.-]+:/+", "/")
    places = places.withColumn("_path", F.regexp_replace("_path", "^/(?=https?:)", ""))
    return out.withColumn("_path", path).join(places, "_path", "left").select("position", "source", "page_content")


def as_documents(df: DataFrame) -> DataFrame:
    """Any table with page_content or text as documents: page_content never null. A document inside page_content (a struct of page_content and metadata) is unwrapped, its metadata (a map) wins over the outer."""
    have = [c for c in ("page_content", "text") if c in df.columns]
    if not have:
        raise TypeError("neither page_content nor text")
    outer = df.schema[have[0]].dataType
    if isinstance(outer, T.StructType):
        inner = [f.name for f in outer]
        if "page_content" not in inner:
            raise TypeError("a document inside a document has no page_content")
        if "metadata" in inner:
            none = F.create_map().cast("map<string,string>")
            own, nested = F.coalesce("metadata", none) if "metadata" in df.columns else none, F.coalesce(F.col(f"{have[0]}.metadata"), none)
            kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(nested, k))
            df = df.withColumn("metadata", F.map_concat(kept, nested))
        df = df.withColumn(have[0], F.col(f"{have[0]}.page_content"))
    return df.withColumn("page_content", F.coalesce(*(F.col(c) for c in have), F.lit("")))


def projected(docs: DataFrame, include_metadata: bool = True, key: str = "vec_id") -> DataFrame:
    """Documents with all their columns, or with their key and text only."""
    return docs if include_metadata else docs.select(key, "page_content")


def cached_sources(sources: DataFrame) -> DataFrame:
    """The scope of the source cache: addresses that are not files."""
    return sources.where(F.regexp_like("source", F.lit("^https?://")))


def web_results(found: DataFrame) -> DataFrame:
    """Search results (title, href, body) without video links, as title, link, snippet."""
    return found.where(~F.contains("href", F.lit("youtube.com"))).select("title", F.col("href").alias("link"), F.col("body").alias("snippet"))
