"""Quality rules: a decision list learned by sequential covering, applied as one Spark conditional expression.

Statistics of whole texts come from one narrow pass over Arrow columns. Rules are grown on two thirds of the labelled rows by
FOIL gain, one threshold at a time, then pruned from the end on the other third; a rule enters the list only while it
stays precise there. The list becomes ``CASE WHEN rule THEN false ... ELSE true``.

Labels are the only thing sampled: at most MAX_LABELLED labelled rows, those with the least hashes of their ids.
Defined cases: null and empty texts have zero for every statistic and fail the base rule; rows that repeat get a row each; without labels
(or without rejects among them) the list is empty and only the base rule speaks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Slice, mix, slices, span_hash, windows
from tessera.llm.work import lean, small_batches

MAX_LABELLED = 20_000
#: A rule's least precision among rows that it was not grown on, and the most rules and conditions.
LEAST_PRECISION, MOST_RULES, MOST_CONDITIONS = 0.95, 12, 4
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
#: Features: a statistic over another (or over one word).
FEATURES = {
    "n_words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols_a_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "words_a_line": ("n_words", "n_lines"), "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "marks_a_word": ("n_marks", "n_words"),
}


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _MARK, _START = _lut(SYMBOLS), _lut(bytes(range(65, 91))), _lut(b"0123456789"), _lut(b"!?.,;:"), np.array([b & 0xC0 != 0x80 for b in range(256)])


def slice_stats(s: Slice) -> np.ndarray:
    """STATS of each text of a slice, as columns."""
    starts, ends, first = s.words()
    out = np.zeros((len(STATS), s.rows), np.int64)
    out[0] = np.diff(first)
    if not len(starts):
        return out
    run = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    per_text = lambda flags: np.diff(run(flags)[s.at])
    chars = run(_START[s.bytes])
    words_chars = np.concatenate(([0], np.cumsum(chars[ends] - chars[starts])))
    out[1] = np.diff(words_chars[first])
    out[2] = per_text(_SYMBOL[s.bytes])
    out[6], out[7], out[8] = (per_text(x[s.bytes]) for x in (_UPPER, _DIGIT, _MARK))
    sums = s.sums()
    owner = np.repeat(np.arange(s.rows), np.diff(first))
    # lines with a word: each word's line starts after the last newline or text start before it
    newline = np.flatnonzero(s.bytes == 10)
    bounds = np.unique(np.concatenate((s.at[:-1], newline + 1)))
    bounds = bounds[bounds < len(s.bytes)]
    line = np.unique(np.searchsorted(bounds, starts, "right") - 1)
    stops = np.minimum(np.append(newline, len(s.bytes))[np.searchsorted(newline, bounds[line])], s.at[np.searchsorted(s.at, bounds[line], "right")])
    of = np.searchsorted(s.at, bounds[line], "right") - 1
    _, at = np.unique(span_hash(sums, bounds[line], stops) ^ mix(of.astype(np.uint64) + np.uint64(1)), return_index=True)
    out[5] = np.bincount(of, minlength=s.rows)
    out[3] = out[5] - np.bincount(of[at], minlength=s.rows)
    # words in windows of three that occur twice or more in their text
    keys = windows(span_hash(sums, starts, ends), 3)
    if len(keys):
        keys = keys ^ mix(owner[: len(keys)].astype(np.uint64) + np.uint64(1))
        whole = owner[: len(keys)] == owner[2:]
        kept = np.sort(keys[whole])
        twice = np.unique(kept[1:][kept[1:] == kept[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hit = whole & (twice[at] == keys)
            covered = np.zeros(len(starts), bool)
            for k in range(3):
                covered[k : k + len(hit)] |= hit
            out[4] = np.bincount(owner[covered], minlength=s.rows)
    return out


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: id, columns in keep, then STATS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(b.num_columns - 1)):
                made = slice_stats(s)
                own = [b.column(i).slice(s.first, s.rows) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x) for x in made)], names)

    small_batches(docs.sparkSession)
    # the pass uses names of its own, so no column of docs can clash with a statistic
    taken = [id_col, *keep]
    names = [f"c{i}" for i in range(len(taken))] + list(STATS)
    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(taken)] + [f"{x} bigint" for x in STATS])
    out = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(taken)), docs[text_col].alias("t")).mapInArrow(lean(run), schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(taken)})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        top, under = FEATURES[self.feature]
        value = F.col(top).cast("double") if under is None else F.col(top) / F.greatest(F.col(under), F.lit(1))
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def features(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: columns[a].astype(float) if b is None else columns[a] / np.maximum(columns[b], 1) for k, (a, b) in FEATURES.items()}


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    rule, held = (), np.ones(len(y), bool)
    while len(rule) < MOST_CONDITIONS and (~y[held]).any():
        p, n = y[held].sum(), (~y[held]).sum()
        best, best_gain = None, 1e-9
        for f in FEATURES:
            v = x[f][held]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, 65)[1:-1])):
                over = v >= t
                for above, hit in ((True, over), (False, ~over)):
                    p1, n1 = y[held][hit].sum(), (~y[held][hit]).sum()
                    if p1 and n1 < n and (gain := p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))) > best_gain:
                        best, best_gain = Condition(f, above, float(t)), gain
        if best is None:
            break
        rule, held = (*rule, best), held & best.holds(x)
    return rule


def learn(columns: dict[str, np.ndarray], reject: np.ndarray, third: np.ndarray) -> list[Rule]:
    """Rules for rejects, in order. third: rows kept for pruning."""
    x, left, rules = features(columns), np.ones(len(reject), bool), []
    while len(rules) < MOST_RULES and (reject & left & ~third).any():
        grown, tried = left & ~third, left & third
        rule = _grow({k: v[grown] for k, v in x.items()}, reject[grown])
        if not rule:
            break
        xt, yt = {k: v[tried] for k, v in x.items()}, reject[tried]

        def worth(r: Rule) -> float:
            hit = covers(r, xt)
            return (yt[hit].sum() - (~yt[hit]).sum()) / max(1, hit.sum())  # noqa: B023

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        hit = covers(rule, xt)
        if not hit.any() or yt[hit].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> list[Rule]:
    """Fit on at most `most` labelled rows; each id counts once, with its least label."""
    spark = docs.sparkSession
    sample = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.min(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most).collect()
    if not sample:
        return []
    y = {r.id: r.y for r in sample}
    ids = spark.createDataFrame([(k,) for k in y], f"{id_col} {labels.schema[id_col].dataType.simpleString()}")
    rows = stats(docs.join(F.broadcast(ids), id_col, "left_semi"), id_col, text_col).where(~base_failed()).distinct().orderBy(id_col, *STATS).toPandas()  # at most `most` rows, of ten numbers
    columns = {k: rows[k].to_numpy() for k in STATS}
    own = rows[id_col].to_numpy()
    third = mix(own.astype(np.uint64) if own.dtype.kind in "iu" else np.array([zlib.crc32(str(i).encode()) for i in own], np.uint64)) % np.uint64(3) == 0
    return learn(columns, np.array([y[i] == 0 for i in rows[id_col]], bool), third)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The list as a conditional expression over STATS: true keeps a row."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, STATS, base_failed and kept for every row of docs."""
    rules = learn_from(docs, labels, id_col, text_col)
    return stats(docs, id_col, text_col).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the list keeps, with all their columns."""
    rules = learn_from(docs, labels, id_col, text_col)
    own = [f"own{i}" for i in range(len(docs.columns))]  # columns of docs may be named as statistics are
    named = docs.toDF(*own)
    rest = [c for c, was in zip(own, docs.columns, strict=True) if was != id_col]
    judged = stats(named, own[docs.columns.index(id_col)], own[docs.columns.index(text_col)], tuple(rest))
    return judged.where(verdict(rules)).select(*own).toDF(*docs.columns)
