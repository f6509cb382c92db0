"""Toxicity by noisy-channel deobfuscation: restore, then score.

A character trigram model is counted over all texts of the corpus. Words that look disguised (digits or signs among letters, a letter three times or more,
marks between single letters, single letters set apart by spaces) are read through a channel: a lattice of what each character may stand for, how often a
repeated one was meant, and which marks were put in. Viterbi decoding under the model picks the likeliest spelling. Plain words are left as they are.

Restored words are scored by a lexicon of words and word beginnings learned from labelled rows: greedy multiple cover of the toxic ones by features
that are precise among all labelled ones; a logistic regression on the hits gives the score. Labels are the only thing sampled: at most
MAX_LABELLED rows, those with the least hashes of their ids.

Defined cases: null and empty texts have no hits and get the score of a text without hits; rows that repeat get a row each; without toxic labels nothing is in the
lexicon and every score is the share of toxic labels (0 without labels); other columns, such as language and source, are never read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import slices
from tessera.llm.work import Work, lean, small_batches

MAX_LABELLED = 20_000
LEAST_SCORE = 0.3
#: A feature of the lexicon: toxic rows it must have, least share of toxic ones among rows with it (first and second choice), and how often a toxic row is covered.
LEAST_ROWS, LEAST_PRECISION, COVER = 4, (0.95, 0.25), 3
PREFIXES = range(3, 7)
MOST_CACHED = 300_000

# What characters stand for in disguised words.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
_MARKS = set(".-_*~'`,/\\:;^ ")
_COST = {"letter": 0.0, "stands": 0.5, "mark": 0.3, "fewer": 0.2}

_SYMBOLS = 28  # 0 edge of a word, 1-26 letters, 27 any other letter
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of byte-class trigrams within words, over all texts: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for b in batches:
            for s in slices(b.column(0)):
                c = _CLASS[s.bytes]
                c = np.concatenate(([0], c, [0]))
                code = (c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:]
                total += np.bincount(code, minlength=len(total))
        total[:_SYMBOLS] = 0  # two edges in a row are between words
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["code", "n"])

    small_batches(docs.sparkSession)
    out = np.zeros(_SYMBOLS**3, np.int64)
    for r in docs.select(docs[text_col]).mapInArrow(lean(run), "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape((_SYMBOLS,) * 3)


class Channel:
    """Decodes disguised words under a trigram model."""

    def __init__(self, counts: np.ndarray):
        smooth = counts + 0.05
        self.cost = -np.log(smooth / smooth.sum(axis=2, keepdims=True))

    @staticmethod
    def symbol(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """For each run of one character, the strings that it may stand for, with costs."""
        out = []
        for m in re.finditer(r"(.)\1*", word, re.S):
            c, n = m.group(1), len(m.group())
            arcs: list[tuple[str, float]] = []
            if c.isalpha():
                arcs = [(c * k, _COST["letter"] if k == n else _COST["fewer"] * (1 + (k == 2))) for k in {1, min(n, 2), n if n < 3 else 2}]
            for x in LEET.get(c, ""):
                arcs += [(x * k, _COST["stands"] + _COST["fewer"] * (k < n)) for k in {1, min(n, 2)}]
            if c in _MARKS:
                arcs.append(("", _COST["mark"]))
            out.append(arcs or [("", 2.0)])
        return out

    def decode(self, word: str) -> str:
        """The likeliest spelling: Viterbi over states of the last two characters."""
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for arcs in self.lattice(word):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in best.items():
                for put, price in arcs:
                    p, q, total = a, b, cost + price
                    for c in put:
                        s = self.symbol(c)
                        total += self.cost[p, q, s] if (p, q) != (0, 0) or text else 1.0
                        p, q = q, s
                    held = after.get((p, q))
                    if held is None or total < held[0]:
                        after[p, q] = (total, text + put)
            best = after
        return min((cost + self.cost[a, b, 0], text) for (a, b), (cost, text) in best.items())[1]


_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_ODD = re.compile(r"(.)\1\1|[0-9@$!|+€£¡]|[^\W\d_][.\-_*~'`,/\\:;^][^\W\d_](?:[.\-_*~'`,/\\:;^][^\W\d_])+", re.S)
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"(.)\1\1")
_ENDS = ".,;:?'\"()[]*%&#-"  # marks that stand for no letter
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")


def restored(token: str, channel: Channel) -> tuple[str, ...]:
    """Words of a token, in lower case: its plain words and, if it looks disguised, what it decodes to."""
    bare = token.strip(_ENDS)
    if bare.isalpha() and not _THRICE.search(bare):
        return (bare,)  # nearly all tokens
    plain = tuple(_PLAIN.findall(token))
    # a sign at the end may belong to the word or not, so both readings are decoded
    ends = {_EDGE.sub("", token), token.strip(".,;:'\"()[]")}
    odd = tuple({channel.decode(x) for x in ends if x and _LETTER.search(x) and _ODD.search(x)})
    return plain + odd


def features(word: str) -> list[str]:
    return [word + "$", *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def words_of(text: str, channel: Channel, cache: dict[str, tuple[str, ...]]) -> Iterator[tuple[str, ...]]:
    """Words of each token, spaced-out words last."""
    low = text.lower()
    for token in low.split():
        got = cache.get(token)
        if got is None:
            if len(cache) >= MOST_CACHED:
                cache.clear()
            got = cache[token] = restored(token, channel)
        yield got
    for m in _SPACED.finditer(low):
        if len(_LETTER.findall(m.group())) >= 3:
            yield (channel.decode(m.group()),)


def _sample(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], most: int, id_col: str, label_col: str) -> DataFrame:
    """(id, text, y) of at most most labelled rows that aren't held out."""
    spark = docs.sparkSession
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(~held_out(F.col("id")))
    rows = chosen.groupBy("id").agg(F.max("y").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most).collect()
    return docs.join(F.broadcast(spark.createDataFrame([(r.id, r.y) for r in rows], f"id {labels.schema[id_col].dataType.simpleString()}, y int")), "id")


class Model:
    """Lexicon and weights. It pickles to a few kilobytes beside the trigram table."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray, channel: Channel):
        self.lexicon, self.weights, self.channel = lexicon, weights, channel
        self.starts = {_stem(f)[: PREFIXES[0]] for f in lexicon}

    def weight(self, words: tuple[str, ...]) -> float:
        return max((self.lexicon.get(f, 0.0) for w in words if w[: PREFIXES[0]] in self.starts for f in features(w)), default=0.0)

    def hits(self, text: str, cache: dict[str, float]) -> tuple[int, int, float]:
        """Tokens of a text, those with a word in the lexicon, and the sum of their log-odds."""
        low = text.lower()
        tokens = low.split()
        weights = list(map(cache.get, tokens))
        if None in weights:
            for i, w in enumerate(weights):
                if w is None:
                    if len(cache) >= MOST_CACHED:
                        cache.clear()
                    weights[i] = cache[tokens[i]] = self.weight(restored(tokens[i], self.channel))
        found = list(filter(None, weights))
        for m in _SPACED.finditer(low):
            if len(_LETTER.findall(m.group())) >= 3 and (w := self.weight((self.channel.decode(m.group()),))):
                found.append(w)
        return len(tokens), len(found), sum(found)

    @staticmethod
    def inputs(tokens: np.ndarray, hits: np.ndarray, odds: np.ndarray) -> np.ndarray:
        return np.stack((np.ones(len(hits)), np.log1p(hits), np.log1p(np.maximum(odds, 0)), np.minimum(1.0, 20 * hits / np.maximum(tokens, 1))), axis=1).astype(float)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _stem(feature: str) -> str:
    return feature.strip("^$")


def _cover(rows: list[list[int]], candidates: list[tuple[str, int, int]], clean_rows: int) -> dict[str, float]:
    """Greedy cover, precise features first: each toxic row COVER times if it can be, by features with the most rows still in need. Words with one beginning count once. Feature -> log of its likelihood ratio."""
    need = [COVER] * len(rows)
    having: dict[int, list[int]] = {}
    for r, own in enumerate(rows):
        for f in own:
            having.setdefault(f, []).append(r)
    chosen: dict[str, float] = {}
    place = {f: k for k, f in enumerate(sorted(having, key=lambda k: (-candidates[k][2], -len(candidates[k][0]), candidates[k][0]), reverse=True))}
    for least in LEAST_PRECISION:
        # gains only fall, so one that is still what it was is the most
        gain = lambda f: sum(need[r] > 0 for r in having[f])
        free = [(-gain(f), place[f], f) for f in having if candidates[f][1] >= least * sum(candidates[f][1:])]
        heapq.heapify(free)
        stems: set[str] = set()
        starts: set[str] = set()
        while free:
            was, k, f = heapq.heappop(free)
            stem = _stem(candidates[f][0])
            if stem in starts or any(stem[:n] in stems for n in range(len(stem) + 1)):
                continue
            now = gain(f)
            if now < 2:
                continue
            if now < -was:
                heapq.heappush(free, (-now, k, f))
                continue
            name, toxic, clean = candidates[f]
            chosen[name] = float(np.log((toxic + 0.5) / (len(rows) + 1) * (clean_rows + 1) / (clean + 0.5)))
            stems.add(stem)
            starts.update(stem[:n] for n in range(len(stem) + 1))
            for r in having[f]:
                need[r] -= 1
    return chosen


def fit(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column] = lambda i: F.lit(False), most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    channel = Channel(trigram_counts(docs))
    # copies would count one text's words many times
    sample = _sample(docs, labels, held_out, most, id_col, label_col).groupBy(F.sha2("text", 256).alias("h")).agg(F.min_by("text", "id").alias("text"), F.max("y").alias("y"))
    sample = Work(spark, "toxicity").keep(sample.select("text", "y"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update({f for own in words_of(text, channel, cache) for w in own for f in features(w)})
            every = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic[f] for f in every], pa.int64()), pa.array([clean[f] for f in every], pa.int64())], ["f", "toxic", "clean"])

    counted = sample.mapInArrow(count, "f string, toxic bigint, clean bigint").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = counted.where((F.col("toxic") >= LEAST_ROWS) & (F.col("toxic") >= min(LEAST_PRECISION) * (F.col("toxic") + F.col("clean")))).orderBy(F.desc("toxic"), "clean", F.length("f"), "f").collect()  # bounded by the labelled sample
    candidates = [(r.f, r.toxic, r.clean) for r in best]
    number = {f: i for i, (f, *_) in enumerate(candidates)}

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            found = [sorted({number[f] for got in words_of(t, channel, cache) for w in got for f in features(w) if f in number}) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["f"])

    rows = [r.f for r in sample.where("y = 1").select("text").mapInArrow(own, "f array<int>").collect()] if candidates else []
    clean_rows = sample.where("y = 0").count()
    model = Model(_cover(rows, candidates, clean_rows), np.zeros(4), channel)
    seen = counts(sample.withColumn("id", F.lit(0)), model, keep=("y",)).select("y", "tokens", "hits", "odds").toPandas().sort_values(["y", "tokens", "hits", "odds"])  # four numbers a sampled row, in an order that does not depend on tasks
    model.weights = _logistic(Model.inputs(*(seen[c].to_numpy(float) for c in ("tokens", "hits", "odds"))), seen["y"].to_numpy(float)) if len(seen) else np.array([-50.0, 0, 0, 0])
    return model


def counts(docs: DataFrame, model: Model, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, columns in keep, tokens, hits and their summed log-odds of every row: one narrow pass."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample: a lexicon that covers each toxic row COVER times, a trigram table
    taken = [id_col, *keep]
    names = [f"c{i}" for i in range(len(taken))] + ["tokens", "hits", "odds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for b in batches:
            got = [m.hits(t.as_py() or "", cache) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64())))], names)

    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(taken)] + ["tokens bigint, hits bigint, odds double"])
    out = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(taken)), docs[text_col].alias("t")).mapInArrow(lean(run), schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(taken)})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tokens, hits, score and predicted of every row."""
    w = [float(x) for x in model.weights]
    hits, tokens = F.col("hits"), F.greatest(F.col("tokens"), F.lit(1))
    z = F.lit(w[0]) + F.lit(w[1]) * F.log1p(hits) + F.lit(w[2]) * F.log1p(F.greatest(F.lit(0.0), F.col("odds"))) + F.lit(w[3]) * F.least(F.lit(1.0), 20 * hits / tokens)
    out = counts(docs, model, id_col, text_col).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
