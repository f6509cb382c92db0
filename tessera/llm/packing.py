"""Best-fit packing of token pieces into sequences of a fixed capacity, in bulk-synchronous rounds.

Pieces are range-sorted by length, longest first, and gaps by what they have left. Each round takes the next range of lengths (down to a sixteenth of the last one's): its pieces are
matched by sweeps to the least gap that holds them (the successor of the length among the gaps), where no gap does a new sequence is opened; pieces and sequences of
equal standing are told apart by rank alone, which resolves all conflicts; matched gaps shrink and go back in order; the state is written, and the next round follows, until no piece is
left. This is best-fit decreasing, exactly, within a lane.

Sweeps are distributed over lanes: pieces are dealt over lanes of about LANE_PIECES by a hash, each with sequences of its own, so that a lane costs a sequence or two that are less than full.
Within a lane both sorted sides are run-length encoded: a round moves at most ``capacity`` lengths and runs of sequences that are alike, which do not grow with the documents. Only
the ranks, and the join of pieces with the plan (length, ranks from-to, sequence, offset), touch all pieces.

Defined cases: null and empty texts are the end token alone; a repeated id is a document each time, so its pieces appear that often; an empty table
gives no rows. A document over the capacity is cut into full pieces, the first of which may be shorter; others are never cut.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import encoder
from tessera.llm.work import Work, buckets_for, lean, small_batches

CAPACITY, END_ID = 1024, 2
#: A round's lengths go down to the last one's least over RANGE.
RANGE = 16
#: Pieces of a lane; its sweeps cost the same however many they are, so lanes only bound the sequences that one task numbers.
LANE_PIECES = 20_000_000
#: Up to so many lanes (of a few thousand runs each) the plan is broadcast.
BROADCAST_LANES = 64


def cut(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of n ids; if any is shorter it is the first."""
    first = n % capacity or capacity
    yield 0, 0, first
    for i, start in enumerate(range(first, n, capacity), 1):
        yield i, start, capacity


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, columns in keep, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    taken = [id_col, *keep]
    names = [f"c{i}" for i in range(len(taken))] + ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own, rows = [], []
                for i, ids in enumerate(encode([t or "" for t in b.column(b.num_columns - 1).slice(at, 256).to_pylist()])):
                    ids += tail
                    for piece, start, length in cut(len(ids) // 4, capacity) if ids else ():
                        part = ids[4 * start : 4 * (start + length)]
                        own.append(at + i)
                        rows.append((piece, start, length, zlib.crc32(part), part))
                index = pa.array(own, pa.int64())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                made = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)][: 4 + with_ids]
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(index) for i in range(b.num_columns - 1)), *made], names)

    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(taken)] + ["piece int, start bigint, length bigint, ids_crc32 bigint"] + ["ids binary"] * with_ids)
    out = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(taken)), docs[text_col].alias("t")).mapInArrow(lean(run), schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(taken)})


Gaps = list[tuple[int, int, int]]


def sweep(counts: dict[int, int], capacity: int, given: Gaps = (), opened: int = 0) -> tuple[list[tuple[int, int, int, int, int]], Gaps, int]:
    """Best fit of lengths (with how many pieces), longest first, into given gaps (gap, first sequence, sequences) and new sequences from `opened` on.

    Returns the plan (length, first rank, pieces, first sequence, offset: the piece of rank first+i goes to sequence first+i at offset), the gaps left and the number of sequences."""
    plan = []
    gaps: list[int] = []  # sorted sizes of gaps that some sequences have
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, how many)

    def put_back(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not runs[gap]:
                insort(gaps, gap)
            runs[gap].append((first, n))

    for run in given:
        put_back(*run)
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        if length > capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    gaps.pop(at)
            else:  # no gap holds this length: new sequences
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            # a sequence that took one stays the best fit, so each is filled before the next
            each = gap // length
            full = min(n, left // each)
            for k in range(each if full else 0):
                plan.append((length, rank, full, first, capacity - gap + k * length))
                rank += full
            left -= each * full
            put_back(gap - each * length, first, full)
            if full < n:
                for k in range(left):
                    plan.append((length, rank, 1, first + full, capacity - gap + k * length))
                    rank += 1
                put_back(gap - left * length, first + full, 1)
                put_back(gap, first + full + 1, n - full - 1)
                left = 0
    return plan, [(gap, first, n) for gap in gaps for first, n in runs[gap]], opened


# Rows of a round's state and outcome by kind. 0: pieces (a: length, c: how many). 1: gaps in order (a: gap, b: first sequence, c: sequences, d: order). 2: sequences opened (c). 3: the plan (a: length, b: first rank,
# c: pieces, d: first sequence, e: offset).
_STATE = "lane int, kind int, a bigint, b bigint, c bigint, d bigint, e bigint"


def _round(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = lambda kind: pdf[pdf.kind == kind]
        held = of(1).sort_values("d")
        plan, gaps, opened = sweep(dict(zip(of(0).a.tolist(), of(0).c.tolist(), strict=True)), capacity, list(zip(held.a.tolist(), held.b.tolist(), held.c.tolist(), strict=True)), int(of(2).c.sum()))
        rows = [(1, gap, first, n, i, 0) for i, (gap, first, n) in enumerate(gaps)] + [(2, 0, 0, opened, 0, 0)] + [(3, *p) for p in plan]
        out = pd.DataFrame(rows, columns=["kind", "a", "b", "c", "d", "e"])
        out.insert(0, "lane", pdf.lane.iloc[0])
        return out

    return run


def rounds(counts: DataFrame, work: Work, capacity: int) -> DataFrame:
    """counts: lane, length, n -> the plan: lane, length, r (first rank), k (pieces), s (first sequence of the lane), o (offset)."""
    none = [F.lit(0).cast("long").alias(c) for c in "bde"]
    pieces_ = counts.select("lane", F.lit(0).alias("kind"), F.col("length").alias("a"), none[0], F.col("n").alias("c"), none[1], none[2])
    lengths = counts.agg(F.max("length").alias("most"), F.min("length").alias("least")).first()
    if lengths.most is not None and lengths.most > capacity:
        raise ValueError(f"a piece of {lengths.most} does not fit {capacity}")
    plans, state, high = [], None, capacity
    while lengths.most is not None and high >= lengths.least:
        low = high // RANGE
        if low < lengths.most:
            now = pieces_.where(F.col("a").between(low + 1, high))
            now = now if state is None else now.unionByName(state)
            done = work.keep(now.groupBy("lane").applyInPandas(_round(capacity), _STATE), "round")
            plans.append(done.where("kind = 3"))
            state = done.where("kind IN (1, 2)")
        high = low
    columns = ["lane", *(F.col(c).alias(n) for c, n in zip("abcde", ("length", "r", "k", "s", "o"), strict=True))]
    return reduce(DataFrame.unionByName, plans).select(*columns) if plans else counts.sparkSession.createDataFrame([], "lane int, length bigint, r bigint, k bigint, s bigint, o bigint")


def pack(found: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """found (a row per piece, with piece and length) with sequence_id and offset; found is read more than once, so keep it first."""
    spark = found.sparkSession
    work = Work(spark, "rounds")
    total = found.count()
    lanes = max(1, -(-total // LANE_PIECES))
    # ranks within a lane and length: pieces are dealt over buckets, as half of all may have one length
    buckets = buckets_for(spark, total, 100_000)
    place = F.xxhash64(id_col, "piece")
    dealt = found.withColumns({"_lane": F.pmod(place, F.lit(lanes)).cast("int"), "_bucket": F.pmod(F.shiftright(place, 20), F.lit(buckets)).cast("int")})
    here = work.keep(dealt.groupBy(F.col("_lane").alias("lane"), "length", F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n")), "counts")
    plan = rounds(here.groupBy("lane", "length").agg(F.sum("n").alias("n")), work, capacity)
    # the plan as one array a lane and length: each piece finds its run there
    runs = plan.groupBy("lane", "length").agg(F.collect_list(F.struct("r", "k", "s", "o")).alias("_runs"))
    runs = runs.withColumnRenamed("lane", "_lane")
    runs = F.broadcast(runs) if lanes <= BROADCAST_LANES else runs
    before = here.withColumn("_before", F.sum("n").over(Window.partitionBy("lane", "length").orderBy("bucket")) - F.col("n")).drop("n").withColumnsRenamed({"lane": "_lane", "bucket": "_bucket"})
    rest = [c for c in found.columns if c not in (id_col, "piece")]
    ranked = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_lane", "length", "_bucket").orderBy(id_col, "piece", *rest)) - 1)
    joined = ranked.join(before, ["_lane", "length", "_bucket"]).join(runs, ["_lane", "length"])  # the first is dealt like the window's rows, so pieces are shuffled once
    rank = F.col("_before") + F.col("_place")
    run = F.filter("_runs", lambda x: (x.r <= rank) & (rank < x.r + x.k))[0]
    out = joined.withColumn("_run", run)
    sequence = F.col("_lane").cast("long") * F.lit(1 << 40) + F.col("_run.s") + rank - F.col("_run.r")
    return out.select(*(out[c] for c in found.columns), sequence.alias("sequence_id"), F.col("_run.o").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokenize, cut and pack. Pieces are kept in the shared folder, so texts are tokenized once."""
    work = Work(docs.sparkSession, "packing")
    return pack(work.keep(pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col, keep), "pieces"), capacity, id_col)
