"""Cutting documents into chunks.

Fixed windows are plain SQL. Splitters that look for separators run as an Arrow function from text to an array of chunks, exploded with their
index; the index counts within a document, so ids do not depend on the order of documents.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators of each kind, strongest first; the last, empty one cuts between characters.
SEPARATORS = {
    "recursive": ("\n\n", "\n", " ", ""),
    "character": ("\n\n",),
    "markdown": ("\n# ", "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n", "\n---\n", "\n\n", "\n", " ", ""),
    "python": ("\nclass ", "\ndef ", "\n\tdef ", "\n    def ", "\n\n", "\n", " ", ""),
    "code": ("\n\n", "\n", ";", "}", "{", "(", ")", " ", ""),
}


@dataclass(frozen=True)
class Options:
    kind: str = "recursive"
    size: int = 1000
    overlap: int = 200
    tokenizer: str | None = None  # of kind token: a file of a model's tokenizer, as the tokenizers library reads it

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise ValueError("size must be positive")
        if self.overlap >= self.size:
            object.__setattr__(self, "overlap", self.size // 4)
        if self.kind not in (*SEPARATORS, "token", "header", "none"):
            object.__setattr__(self, "kind", "recursive")


def _merge(parts: list[str], size: int, overlap: int, length=len) -> list[str]:
    """Consecutive parts joined up to size; each chunk starts with as many last parts of the one before as fit overlap."""
    out, held, total = [], [], 0
    for part in parts:
        n = length(part)
        if held and total + n > size:
            out.append("".join(held))
            while held and (total > overlap or total + n > size):
                total -= length(held.pop(0))
        held.append(part)
        total += n
    return out + ["".join(held)] if held else out


def split_text(text: str, separators: tuple[str, ...], size: int, overlap: int) -> list[str]:
    """Cut at the strongest separator that occurs (it stays with the part before it), cut parts that are still too long at weaker ones, merge small ones."""
    found = next((s for s in separators if s == "" or s in text), None)
    if found is None or len(text) <= size:
        return [text.strip()] if text.strip() else []
    weaker = separators[separators.index(found) + 1 :]
    parts = list(text) if found == "" else [x + found for x in text.split(found)[:-1]] + [text.split(found)[-1]]
    out: list[str] = []
    small: list[str] = []
    for part in (p for p in parts if p):
        if len(part) <= size:
            small.append(part)
            continue
        out += _merge(small, size, overlap)
        small = []
        out += split_text(part, weaker, size, overlap) if weaker else [part]
    out += _merge(small, size, overlap)
    return [c.strip() for c in out if c.strip()]


def split_headers(text: str) -> list[str]:
    """One chunk a section that starts with a heading line."""
    return [s.strip() for s in re.split(r"(?m)^(?=#{1,6} )", text) if s.strip()]


def split_tokens(text: str, size: int, overlap: int) -> list[str]:
    """Windows of words and marks with the white space that follows them (a tokenizer of our own, not a model's)."""
    tokens = re.findall(r"(?:[^\W_]+|[\W_])\s*", text)
    step = max(1, size - overlap)
    return ["".join(tokens[i : i + size]).strip() for i in range(0, max(1, len(tokens) - overlap), step)] if text.strip() else []


@functools.lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True  # their strings in a text are ordinary text
    return out


def split_model_tokens(text: str, size: int, overlap: int, path: str) -> list[str]:
    """Windows of a model's tokens, cut before the character that a token begins with: a character of several tokens is never cut, and goes to the later window."""
    starts = [a for a, _ in _tokenizer(path).encode(text, add_special_tokens=False).offsets]
    step = max(1, size - overlap)
    ends = [*starts, len(text)]
    windows = ((0 if i == 0 else starts[i], ends[min(i + size, len(starts))]) for i in range(0, max(1, len(starts) - overlap), step)) if starts else ()
    return [c for c in (text[a:b].strip() for a, b in windows) if c]


def chunk_one(text: str, o: Options) -> list[str]:
    if o.kind == "none":
        return [text]
    if o.kind == "header":
        return split_headers(text)
    if o.kind == "token" and o.tokenizer:
        return split_model_tokens(text, o.size, o.overlap, o.tokenizer)
    if o.kind == "token":
        return split_tokens(text, o.size, o.overlap)
    return split_text(text, SEPARATORS[o.kind], o.size, o.overlap)


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat_ws("_", F.substring(F.md5(source), 1, 8), index.cast("string"), F.lit("v1"))


def chunk(docs: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_index, chunk_id, page_content."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_one(t or "", options))

    d = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut(F.col(text_col))).alias("chunk_index", "page_content"))
    return d.select("doc_id", "chunk_index", chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"), "page_content")


def sliding(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of fixed size with SQL alone: start = i (size - overlap), as long as a window adds characters."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text_col) - F.lit(overlap)) / step).cast("int") - 1)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    content = F.col("t").substr(F.col("chunk_index") * step + 1, F.lit(size))
    return d.where(F.length("t") > 0).select("doc_id", "chunk_index", chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"), content.alias("page_content"))


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.length("page_content")).alias("n_chars"), F.avg(F.length("page_content")).alias("mean_chars"), (F.count("*") / F.countDistinct("doc_id")).alias("chunks_per_doc"))
