"""Bytes that stand in a string of ``least`` bytes which also starts elsewhere, found by threshold-bounded interval expansion on Burrows-Wheeler transforms.

What is compared is windows of ``least`` bytes. A window is dealt by its anchor, the least hashed substring of ``k < least`` bytes within it (the first of equals), so equal windows
have equal anchors and come to the same task; runs of windows with one anchor travel as one segment, equal segments as one with a count, and windows whose anchor occurs once (anchors are counted first, and those that repeat are told by
a sketch of them) do not travel at all. A task builds the transform of a block of segments (whole anchors only) and extends intervals backward, breadth first: level l sets the boundaries between neighbours in suffix order that share exactly l
bytes, and the search stops at ``least``; neighbours without a boundary share ``least`` bytes or more. An anchor with more than ``HOT`` different segments is not dealt to one task: its segments are cut
again by longer anchors, up to ``least - 1`` bytes, where an anchor has at most 512 different windows. So nothing is capped and no group grows with the input.

Defined cases: null and empty texts have 0 bytes and nothing to remove; texts below ``least`` bytes lose nothing; of equal texts of ``least`` bytes or more each loses all of itself, repeated rows and ids
included; rows without an id are kept; an empty table gives no rows; other columns are ignored. Long texts are hashed in overlapping stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm.words import U, Slice, slices, span_hash
from tessera.llm.work import Work, buckets_for, lean, small_batches

LEAST = 200
#: Different segments of an anchor that are compared in one task.
HOT = 4096
#: Bytes whose transform is built at once, and bytes a task of them.
BLOCK, TASK = 2 << 20, 16 << 20
#: Bytes of a text that are hashed at once (places take 24 bits of an anchor's rank).
STRETCH = 1 << 20
#: Anchors that are counted at once, cells of a row of the sketch for each that repeats, and segments that a task remembers to have sent.
FLUSH, CELLS, SEEN = 1 << 20, 5, 1 << 18
_PLACE = (1 << 24) - 1


def anchor_sizes(least: int) -> list[int]:
    """Lengths of anchors, from the first deal on; the last leaves two of them in a window."""
    return sorted({max(1, least // 2), max(1, least * 4 // 5), max(1, least * 19 // 20), max(1, least - 1)})


def ranks(data: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first depth symbols (0 ends a string; left: symbols before it), equal ones with equal ranks: prefixes of 7 symbols, then doubled."""
    n = len(data)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        own = np.zeros(n, np.int64)
        own[: n - j] = data[j:]
        own[left <= j] = 0
        key |= own
    rank, size, before = _dense(key), 7, 0
    while size < depth:
        classes = int(rank.max()) + 1
        if classes in (n, before):
            break
        before = classes
        later = np.zeros(n, np.int64)
        later[: n - size] = rank[size:] + 1
        later[left <= size] = 0
        rank, size = _dense(rank * (n + 2) + later), 2 * size
    return rank


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    in_order = key[order]
    step = np.empty(len(key), np.int64)
    step[0], step[1:] = 0, in_order[1:] != in_order[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(step)
    return out


def shared_starts(body: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """body: bytes of strings side by side, ends: where each ends -> starts (in body) of substrings of least bytes that start elsewhere in body, too, within one string."""
    s = len(ends)
    data = np.zeros(len(body) + s, np.int64)
    own = np.repeat(np.arange(s), np.diff(ends, prepend=0)) + np.arange(len(body))
    data[own] = body.astype(np.int64) + 1
    stops = ends + np.arange(s)
    n = len(data)
    left = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(n)
    rows = np.argsort(ranks(data, left, least), kind="stable")

    # the transform, where its runs begin, and the step from a row to that of the suffix one symbol longer
    bwt = data[rows - 1]
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)
    begins = np.flatnonzero(np.diff(bwt, prepend=-1))
    symbol, run = bwt[begins], np.cumsum(np.diff(bwt, prepend=-1) != 0) - 1
    begins = np.append(begins, n)

    open_ = np.ones(n + 1, bool)  # rows whose first shared length with the row before is not known
    open_[[0, n]] = False
    lo, hi = np.array([0]), np.array([n - 1])
    for level in range(least):
        first, last = run[lo], run[hi]
        many = last - first + 1
        which = np.repeat(np.arange(len(lo)), many)
        runs = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(which))
        top, end, c = np.maximum(begins[runs], lo[which]), np.minimum(begins[runs + 1] - 1, hi[which]), symbol[runs]
        if many.max(initial=1) > 1:  # runs of the same symbol within an interval are one extension
            order = np.argsort(which * 512 + c, kind="stable")
            which, c, top, end = which[order], c[order], top[order], end[order]
            new = np.flatnonzero((np.diff(which, prepend=-1) != 0) | (np.diff(c, prepend=-1) != 0))
            top, end, c = top[new], end[np.append(new[1:], len(end)) - 1], c[new]
        real = c > 0 if level else c >= 0  # ends of strings are extended from the root only
        lo, hi = lf[top[real]], lf[end[real]]
        if not level:
            hi[c[real] == 0] = s - 1
            lo[c[real] == 0] = 0
        fresh = open_[hi + 1]
        lo, hi = lo[fresh], hi[fresh]
        open_[hi + 1] = False
        if not len(lo):
            break
    shared = np.zeros(n, bool)
    same = np.flatnonzero(open_)
    shared[rows[same]] = shared[rows[same - 1]] = True
    return np.flatnonzero(shared[own] & (left[own] >= least))


class Windows:
    """Runs of windows of a slice that share an anchor: first and last start, and the hash of the anchor."""

    def __init__(self, s: Slice, least: int, size: int):
        n = len(s.bytes)
        none = np.zeros(0, np.int64)
        self.first, self.last, self.key = none, none, np.zeros(0, np.uint64)
        if n < least:
            return
        starts = np.arange(n - size + 1)
        h = span_hash(s.sums(), starts, starts + size)
        low = (h & ~U(_PLACE)) | starts.astype(np.uint64)
        span, w = 1, least - size + 1
        while 2 * span <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        anchor = (low & U(_PLACE)).astype(np.int64)
        row = np.searchsorted(s.at, np.arange(len(anchor)), "right") - 1
        fits = np.arange(len(anchor)) + least <= s.at[row + 1]
        new = fits.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~fits[:-1] | (row[1:] != row[:-1])
        end = fits.copy()
        end[:-1] &= new[1:] | ~fits[1:]
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(end)
        self.key, self.row = h[anchor[self.first]], row[self.first]


def _stretches(column: pa.Array, least: int) -> Iterator[tuple[Slice, int]]:
    """Slices of a binary column; a long value comes in stretches that overlap by least - 1 bytes, each with its place."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    plain = pa.LargeStringArray.from_buffers(len(column), offsets, data, offset=column.offset)
    for s in slices(plain):
        if s.rows > 1 or len(s.bytes) <= STRETCH:
            yield s, 0
            continue
        for p in range(0, len(s.bytes) - least + 1, STRETCH):
            part = s.bytes[p : p + STRETCH + least - 1]
            yield Slice(s.first, part, np.array([0, len(part)])), p


_PIECES = "unit string, multi boolean, start bigint, key bigint, seg binary, windows bigint, body binary"


def _keys(units: DataFrame, least: int, size: int) -> DataFrame:
    """key, n: how often each anchor occurs in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for s, _ in _stretches(b.column(2), least):
                held.append(Windows(s, least, size).key)
                n += len(held[-1])
                if n >= FLUSH:
                    yield counted(held)
                    held, n = [], 0
        if n:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return units.mapInArrow(lean(run), "key bigint, n bigint")


def _repeated(units: DataFrame, work: Work, least: int, size: int) -> tuple[str, int]:
    """A sketch that tells (never wrongly no) whether an anchor occurs more than once. Anchors are counted exactly, so it holds those that do, a small part of all."""
    often = work.keep(_keys(units, least, size).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "repeated")
    width = sketch.width_for(CELLS * often.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield sketch.partial(b.column(0).to_numpy().view(np.uint64), width, 1)

    return sketch.merge(often.mapInArrow(lean(run), sketch.SCHEMA), width, 1, work, "anchors")


def _pieces(units: DataFrame, least: int, size: int, kept: tuple[str, int]) -> DataFrame:
    """Segments whose anchors may occur elsewhere; a task sends the bytes of equal ones once, as a rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sketch.Bits(kept), set()
        for b in batches:
            unit, multi = b.column(0), b.column(1)
            for s, place in _stretches(b.column(2), least):
                w = Windows(s, least, size)
                at = np.flatnonzero(bits.reach(w.key))
                if not len(at):
                    continue
                view, first, last = s.bytes.tobytes(), w.first[at], w.last[at]
                segs, bodies = [], []
                for p, q in zip(first.tolist(), last.tolist(), strict=True):
                    body = view[p : q + least]
                    seg = xxhash.xxh3_128_digest(body)
                    bodies.append(None if seg in seen else body)
                    seen.add(seg)
                    segs.append(seg)
                if len(seen) > SEEN:
                    seen.clear()
                own = pa.array(w.row[at] + s.first)
                start = first - s.at[w.row[at]] + place
                yield pa.RecordBatch.from_arrays(
                    [unit.take(own), multi.take(own), pa.array(start), pa.array(w.key[at].view(np.int64)), pa.array(segs, pa.binary()), pa.array(last - first + 1), pa.array(bodies, pa.binary())],
                    ["unit", "multi", "start", "key", "seg", "windows", "body"],
                )

    return units.mapInArrow(lean(run), _PIECES)


def _blocks(segs: DataFrame, least: int, tasks: int) -> DataFrame:
    """seg, p, q: windows p to q - 1 of a segment that start in other segments of its anchor, too."""

    def expand(names: list[bytes], bodies: list[bytes]) -> pa.RecordBatch:
        body = np.frombuffer(b"".join(bodies), np.uint8)
        ends = np.cumsum([len(x) for x in bodies])
        at = shared_starts(body, ends, least)
        own = np.searchsorted(ends, at, "right")
        cut = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(own, prepend=-1) != 0))
        p, q = at[cut], at[np.append(cut[1:], len(at)) - 1] + 1 if len(at) else at
        own = own[cut]
        base = (ends - np.array([len(x) for x in bodies]))[own]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).take(pa.array(own)), pa.array(p - base), pa.array(q - base)], ["seg", "p", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, own, now = ([], []), 0, [], None

        def settle() -> None:
            nonlocal size
            if len(own) > 1:  # windows of one segment differ from each other
                for seg, body in own:
                    block[0].append(seg)
                    block[1].append(body)
                    size += len(body)
            own.clear()

        for b in batches:
            for key, seg, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != now:
                    settle()
                    now = key
                    if size >= BLOCK:
                        yield expand(*block)
                        block, size = ([], []), 0
                own.append((seg, body))
        settle()
        if block[0]:
            yield expand(*block)

    return segs.select("key", "seg", "body").repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(lean(run), "seg binary, p bigint, q bigint")


def _shared(units: DataFrame, work: Work, least: int, sizes: list[int]) -> DataFrame:
    """units: unit, multi (there are others like it), body -> unit, p, q: starts of windows that start elsewhere, too; ranges may repeat."""
    spark, size = work.spark, sizes[0]
    pieces = work.keep(_pieces(units, least, size, _repeated(units, work, least, size)), "pieces")
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    segs = pieces.groupBy("seg").agg(first("body"), first("key"), first("windows"), (F.max("multi") | (F.count("*") > 1)).alias("multi"))
    segs = work.keep(segs, "segments")
    hot = work.keep(segs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), "hot") if sizes[1:] else None
    some = bool(hot is not None and hot.take(1))
    rest = segs.join(hot, "key", "left_anti") if some else segs
    total = rest.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    hits = _blocks(rest, least, buckets_for(spark, total, TASK))
    if some:
        again = segs.join(hot, "key", "left_semi").select(F.hex("seg").alias("unit"), "multi", "body")
        again = work.keep(again, "again")
        deeper = _shared(again, work, least, sizes[1:])
        hits = hits.union(deeper.select(F.unhex("unit").alias("seg"), "p", "q"))
    # a segment that occurs more than once is shared as a whole, whatever else its windows are found in
    whole = segs.where("multi").select("seg", F.lit(0).cast("long").alias("p"), F.col("windows").alias("q"))
    hits = work.keep(whole.union(hits), "hits")
    return pieces.join(hits, "seg").select("unit", (F.col("start") + F.col("p")).alias("p"), (F.col("start") + F.col("q")).alias("q"))


def _listed(keys: DataFrame, work: Work, name: str) -> tuple[str, int]:
    """A sketch that tells (never wrongly no) whether a text digest is among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield sketch.partial(_digests(b.column(0)), width, 1)

    width = sketch.width_for(4 * keys.count())
    return sketch.merge(keys.mapInArrow(lean(run), sketch.SCHEMA), width, 1, work, name)


def _digests(t: pa.Array) -> np.ndarray:
    return np.array([int(x[:16], 16) for x in t.to_pylist()], np.uint64)


def _among(texts: DataFrame, kept: tuple[str, int], wanted: bool) -> DataFrame:
    """Texts (t, body) that may be listed, or those that are certainly not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.Bits(kept)
        for b in batches:
            out = b.filter(pa.array(bits.reach(_digests(b.column(0))) == wanted))
            if out.num_rows:
                yield out

    return texts.mapInArrow(lean(run), "t string, body binary")


def spans(ranges: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Ranges of window starts (any order, repeats allowed) -> maximal ranges of bytes that the windows cover."""
    out: list[list[int]] = []
    for p, q in sorted(ranges):
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], q + least - 1)
        else:
            out.append([p, q + least - 1])
    return [(p, q) for p, q in out]


def remove(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends of removed runs in bytes) of every row."""
    spark, work, sizes = docs.sparkSession, Work(docs.sparkSession, "repeats"), anchor_sizes(least)
    small_batches(spark)
    body = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.sha2(body, 256).alias("t"), body.alias("body"))
    rows = work.keep(docs.select(docs[id_col].alias("doc_id"), F.sha2(body, 256).alias("t"), F.octet_length(body).cast("long").alias("n_bytes")), "rows")
    copies = rows.where(F.col("n_bytes") >= least).groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t")
    copies = work.keep(copies, "copies")
    long = F.octet_length("body") >= least
    listed = _listed(copies, work, "copied")
    single = _among(texts.where(long), listed, False).select(F.col("t").alias("unit"), F.lit(False).alias("multi"), "body")
    often = work.keep(_among(texts.where(long), listed, True).groupBy("t").agg((F.count("*") > 1).alias("multi"), F.first("body").alias("body")), "often")
    units = single.union(often.select(F.col("t").alias("unit"), "multi", "body"))
    found = _shared(units, work, least, sizes).withColumnRenamed("unit", "t")
    found = found.join(copies, "t", "left_anti").groupBy("t").agg(F.collect_set(F.struct("p", "q")).alias("ranges"))  # copies go whole
    found = work.keep(found, "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, text, ranges in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text, own, kept, at = memoryview(text.as_buffer()), spans([(r["p"], r["q"]) for r in ranges], least), hashlib.sha256(), 0
                for p, q in own:
                    kept.update(text[at:p])
                    at = q
                kept.update(text[at:])
                out.append((t, sum(q - p for p, q in own), len(own), kept.hexdigest(), [x for s in own for x in s]))
            if out:
                t, removed, n, digest, places = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(digest), pa.array(places, pa.list_(pa.int64()))], ["t", "n_removed", "n_spans", "kept_sha256", "spans"]
                )

    touched = _among(texts.where(long), _listed(found.select("t"), work, "touched"), True).join(found, "t")
    schema = "t string, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"
    cut = touched.select("t", "body", "ranges").mapInArrow(lean(run), schema)
    gone = copies.select("t", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"), F.lit(None).cast("array<bigint>").alias("spans"))
    changed = work.keep(cut.union(gone), "changed")
    out = rows.join(changed, "t", "left")
    all_gone = F.col("n_spans").isNotNull() & F.col("n_removed").isNull()
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "t").alias("kept_sha256"),
        F.when(all_gone, F.array(zero, F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<bigint>"))).alias("spans"),
    )
