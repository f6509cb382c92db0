"""Phrases whose words keep together: frequent n-grams found through merged count-min sketches, counted exactly, scored and subsumed.

First pass: each task sketches the n-grams of two and more words of its texts (hashed together with their language); merged sketches never undercount. Second pass: n-grams whose estimate,
and that of all n-grams within them, reaches the least count are counted exactly, by their words, pre-aggregated in batches and again before the shuffle; single words are counted alongside. So no
frequent phrase is lost and no count is an estimate. A phrase then scores by its weakest cut, ``2 * scale * a // (l + r)`` over its two parts' counts, in decimals of 38 digits, and goes if a longer phrase takes up
most of its occurrences.

Words: ASCII letters are lower-cased, texts end a piece at ``.,;:!?`` and line ends, and words are what space and tab part. No phrase crosses a piece or a text.

Defined cases: null and empty texts have no words; a null language counts as ``und``, together with rows that say so; repeated rows count each; equal scores go by count, then by the
bytes of the phrase; a language without candidates, and an empty table, give no rows; other columns are ignored. A text longer than a slice is cut at ends of pieces only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm.words import SLICE_BYTES, Slice, U, mix, slices, span_hash, windows
from tessera.llm.work import Work, buckets_for, lean, small_batches

LEAST, LONGEST, SCALE, SUBSUMED, TOP = 30, 4, 1_000_000, 80, 2000
_END = np.zeros(256, bool)
_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _END.copy()
_GAP[[0x20, 0x09]] = True
#: Words whose n-grams are sketched or counted together.
FLUSH_WORDS = 600_000
#: Bytes of text a word, for the size of the sketch.
WORD_BYTES = 6
UNKNOWN = "und"


@dataclass
class Words:
    """Words of a slice side by side, one space after each: starts, lengths, piece and row of each word, and its hash."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    piece: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def _parts(s: Slice) -> Iterator[Slice]:
    """A slice that is one long text, cut at ends of pieces."""
    if s.rows > 1 or len(s.bytes) <= 2 * SLICE_BYTES:
        yield s
        return
    ends = np.flatnonzero(_END[s.bytes])
    p = 0
    while p < len(s.bytes):
        k = int(np.searchsorted(ends, p + SLICE_BYTES))
        q = int(ends[k]) + 1 if k < len(ends) else len(s.bytes)
        yield Slice(s.first, s.bytes[p:q], np.array([0, q - p]))
        p = q


def words_of(s: Slice) -> Words:
    s = s.lowered()
    inside = ~_GAP[s.bytes]
    edge = np.zeros(len(inside) + 1, bool)
    edge[s.at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    row = np.searchsorted(s.at, starts, "right") - 1
    piece = np.cumsum(_END[s.bytes])[starts] + row
    hashes = span_hash(s.sums(), starts, ends)
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - lengths - 1
    data = np.full(int(to[-1] + lengths[-1]) + 1 if len(to) else 0, 0x20, np.uint8)
    held = np.repeat(to - starts, lengths) + np.flatnonzero(inside)
    data[held] = s.bytes[inside]
    return Words(data, to, lengths, piece, row + s.first, hashes)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, pa.Array]]:
    """Words of slices of (lang, text) batches, with the hash of the language of each word, and the languages of the batch."""
    for b in batches:
        langs = b.column(0).fill_null(UNKNOWN).dictionary_encode()
        salt = np.array([_text_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)
        for whole in slices(b.column(1)):
            for s in _parts(whole):
                if len(s.bytes) and len(w := words_of(s)):
                    yield w, salt[w.row], langs


@functools.lru_cache(4096)
def _text_hash(text: str) -> int:
    data = text.encode()
    s = Slice(0, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return int(span_hash(s.sums(), np.array([0]), np.array([len(data)]))[0])


def _grams(w: Words, salt: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words, and which of them lie within a piece."""
    h = mix(windows(w.hash, size) ^ salt[: max(0, len(w) - size + 1)])
    return h, w.piece[: len(h)] == w.piece[size - 1 :]


def sketched(docs: DataFrame, width: int, longest: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for w, salt, _ in _cut(batches):
            for size in range(2, longest + 1):
                h, whole = _grams(w, salt, size)
                held.append(h[whole])
            n += len(w)
            if n >= FLUSH_WORDS:
                yield sketch.partial(np.concatenate(held), width, least)
                held, n = [], 0
        if n:
            yield sketch.partial(np.concatenate(held), width, least)

    return docs.mapInArrow(lean(run), sketch.SCHEMA)


def counted(docs: DataFrame, kept: tuple[str, int], longest: int) -> DataFrame:
    """lang, words, phrase, n of batches: all words, and n-grams that may be frequent. Equal ones are told by the numbers of their words, not by hashes."""

    def flush(held: list[tuple], names: pa.Array) -> Iterator[pa.RecordBatch]:
        data = np.concatenate([w.data for w, *_ in held])
        base = np.cumsum([0, *(len(w.data) for w, *_ in held[:-1])])
        starts = np.concatenate([w.starts + k for (w, *_), k in zip(held, base, strict=True)])
        ends = starts + np.concatenate([w.lengths for w, *_ in held])
        lang = np.concatenate([code for _, code, _ in held])
        spaced = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data))
        word = spaced.dictionary_encode().indices.to_numpy().astype(np.int64)
        one = int(word.max()) + 1
        number = lang  # of the n-gram that starts at a word, one word shorter each time
        for size in range(1, longest + 1):
            at = np.flatnonzero(np.concatenate([live[size - 1] for *_, live in held]))
            if not len(at):
                return
            _, first, inverse, n = np.unique(number[at] * one + word[at + size - 1], return_index=True, return_inverse=True, return_counts=True)
            number = np.zeros(len(starts), np.int64)
            number[at] = inverse
            own = at[first]
            length = ends[own + size - 1] - starts[own]
            offsets = np.concatenate([[0], np.cumsum(length)])
            chars = data[np.repeat(starts[own] - offsets[:-1], length) + np.arange(offsets[-1])]
            phrase = pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(offsets), pa.py_buffer(chars)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[own])), pa.array(np.full(len(own), size, np.int32)), phrase, pa.array(n)], ["lang", "words", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n, ids = sketch.Bits(kept), [], 0, {}
        for w, salt, langs in _cut(batches):
            code = np.array([ids.setdefault(x, len(ids)) for x in langs.dictionary.to_pylist()])[langs.indices.to_numpy()][w.row]
            lives = [np.ones(len(w), bool)]
            for size in range(2, longest + 1):
                h, whole = _grams(w, salt, size)
                live = np.zeros(len(w), bool)
                live[: len(h)] = whole & lives[-1][: len(h)] & lives[-1][1 : len(h) + 1]
                at = np.flatnonzero(live)
                live[at] = bits.reach(h[at])
                lives.append(live)
            held.append((w, code, lives))
            n += len(w)
            if n >= FLUSH_WORDS:
                yield from flush(held, pa.array(list(ids), pa.string()))
                held, n = [], 0
        if n:
            yield from flush(held, pa.array(list(ids), pa.string()))

    return docs.mapInArrow(lean(run), "lang string, words int, phrase string, n bigint")


def frequent(docs: DataFrame, work: Work, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, words, phrase, n: exact counts of all words, and of all longer n-grams that occur least times in a language (and some that do not)."""
    small_batches(docs.sparkSession)
    d = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = sketch.width_for(size // WORD_BYTES)
    kept = sketch.merge(sketched(d, width, longest, min(least, 255)), width, min(least, 255), work, "sketch")
    return counted(d, kept, longest).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED, top: int | None = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score: each language's first ``top`` phrases (all if None, without a rank)."""
    work = Work(docs.sparkSession, "phrases")
    counts = work.keep(frequent(docs, work, least, longest, lang_col, text_col), "counts")
    totals = counts.where("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= least)
    candidates = often.where("words > 1").withColumnRenamed("n", "a")

    # both parts of each cut, looked up by their words; a part that is a very common word has one row to be looked up and many that ask, which adaptive joins split
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cut = candidates.select("lang", "phrase", "words", "a", k).withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cut = cut.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    part = lambda side, n: often.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumn("score", F.expr(f"(cast({2 * SCALE} as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    weakest = cut.groupBy("lang", "phrase", "words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("w"))
    scored = weakest.select("lang", "phrase", "words", "w.a", "w.l", "w.r", "w.score")

    # what each longer phrase has within it: the count of the longest-lived one decides
    within = [F.expr(f"array_join(slice(w, {i + 1}, {size}), ' ')") for size in range(2, longest) for i in range(longest - size + 1)]
    spans = [(i, size) for size in range(2, longest) for i in range(longest - size + 1)]
    inner = F.array_compact(F.array(*(F.when(F.col("words") > size, F.when(F.col("words") >= i + size, e)) for (i, size), e in zip(spans, within, strict=True))))
    longer = candidates.where("words > 2").withColumn("w", F.split("phrase", " ", -1)).select("lang", "a", F.explode(inner).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("within").isNull() | (exact("within") * 100 < exact("a") * subsumed))
    left = left.drop("within").join(totals, "lang")
    if top is None:
        return left
    return ranked(work.keep(left, "scored"), top)


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first top rows of each language: first of parts of it, then of the parts' best, and so on, so no task sorts a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = buckets_for(scored.sparkSession, scored.count(), 50 * top)
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    while parts > 1:
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        parts = (parts + 31) // 32
        scored = scored.withColumn("part", F.pmod("part", F.lit(parts)))
    scored = scored.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return scored.where(F.col("rank") <= top)
