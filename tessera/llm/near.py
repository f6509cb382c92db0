"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles, exact, down to connected components.

Sets of one content are collapsed first, so copies cost a row each. Then, with the threshold t and for a set of a shingles:

* Small sets (a up to a boundary) enumerate fixed-size subsets: for every size b that a partner may have, a pair must share c = ceil(t(a+b)/(1+t)) shingles, so
  both list their c-subsets, and a shared subset is a link.
* Large sets, and small ones with partners beyond the boundary, post their first a - ceil(ta) + 1 shingles to inverted lists, which are scanned: any linked pair
  meets in a list. The order of shingles puts frequent ones last (then by hash), so lists are short (a long one is dealt over parts) and what many documents share (lines, passages) is
  posted only by documents that have little else.

The boundary minimises rows written by subsets plus rows posted and scanned, from the histogram of sizes. Links are found in three rounds, so that a group of n near
copies does not cost n*n pairs. Round one pairs each member of a list with the list's least one only. The others take the lists of three or more
whose members are still in different components: round two compares members with large components as wholes, against indexes of their blocks, round three pairs members of small
ones across components, in blocks of bounded size. A pair is dropped before its texts are fetched only if the
shingles that it shares among those posted cannot reach the threshold. What is left is compared exactly. So no link between different components is lost; links within one are not all tested.

Defined cases: null, empty and word-less texts have no shingle and are linked with nothing; a text with fewer words than a shingle is one shingle; rows that share
an id are one document that links by any of its texts, and give a row each; ids are integers; rows with a null id are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.words import mix, slices, span_hash, windows
from tessera.llm.work import Work, buckets_for, by_bucket, lean, small_batches

U = np.uint64
#: The threshold as a fraction, compared in whole numbers: TOP * union <= BOTTOM * intersection.
TOP, BOTTOM = 75, 100
SHINGLE = 5
#: The most frequent shingles known to all tasks (8 bytes each), least documents of one, and least in a batch of a task for it to be counted.
MOST_HEAVY, HEAVY, HEAVY_HERE = 1 << 20, 8, 2
#: Sets of which a task remembers that it has had them (copies beyond cost only time).
MOST_SEEN = 200_000
#: A list of a frequent shingle is dealt over parts of about this many members.
PART = 4096
#: No boundary between small and large sets is above this.
MOST_SMALL = 14
#: Members of a list in a block of which pairs are looked at, and shingles in a block of a component that is compared as a whole.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Representatives of a component that is compared as a whole.
LARGE = 64
#: Bits of a set by which pairs are left out before they are written.
BITS = 2048
#: Least and most bits of the filter of ids whose texts are fetched (eight an id between them); false positives only cost a row.
FILTER_BITS = (1 << 16, 1 << 27)
#: Mark of a posting to a split list. A size is below it, as texts are; a subset of c of a shingles has -(a * 64 + c) in its place.
SPLIT = 1 << 30


def needed(a: int, b: int) -> int:
    """Least common shingles of linked sets of a and b: ceil(TOP (a + b) / (BOTTOM + TOP))."""
    return -(-TOP * (a + b) // (BOTTOM + TOP))


def least_partner(a: int) -> int:
    return -(-TOP * a // BOTTOM)


def posted(a):
    """How many of a shingles are posted, in the common order."""
    return a - -(-TOP * a // BOTTOM) + 1


def sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text, A-Z in lower case."""
    for s in slices(column):
        low = s.lowered()
        starts, ends, first = low.words()
        hashes = span_hash(low.sums(), starts, ends) if len(starts) else np.zeros(0, U)
        whole = windows(hashes, size)
        for r in range(s.rows):
            a, b = first[r], first[r + 1]
            yield s.first + r, np.unique(whole[a : b - size + 1] if b - a >= size else windows(hashes[a:b], b - a) if b > a else hashes[:0])


def content_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        return int(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U).view(np.int64)), int(mix(hashes ^ U(0x5A5A5A5A5A5A5A5A)).sum(dtype=U).view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: id, set size, content key. Kind 1: a shingle that is in several different sets here, and in how many."""
    seen: set[tuple[int, int]] = set()
    kept: list[np.ndarray] = []
    held = 0

    def frequent() -> pa.RecordBatch:
        shingles, n = np.unique(np.concatenate(kept or [np.zeros(0, U)]), return_counts=True)
        often = n >= HEAVY_HERE
        k = int(often.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), pa.array(shingles[often].view(np.int64)), pa.array(n[often].astype(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], ["kind", "a", "n", "k1", "k2"])

    for b in batches:
        ids = b.column(0).to_pylist()
        rows = []
        for i, s in sets(b.column(1)):
            key = content_key(s)
            rows.append((0, ids[i], len(s), *key))
            if key not in seen:
                if len(seen) < MOST_SEEN:
                    seen.add(key)
                kept.append(s)
                held += len(s)
                if held > 2_000_000:
                    yield frequent()
                    kept, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int8(), *[pa.int64()] * 4), strict=True)], ["kind", "a", "n", "k1", "k2"])
    yield frequent()


def subset_sizes(a: int, small: int) -> list[int]:
    """Sizes of subsets that a set of a lists for partners up to the boundary."""
    top = min(small, BOTTOM * a // TOP)
    return sorted({needed(a, b) for b in range(least_partner(a), top + 1)} & set(range(1, a + 1))) if a <= small else []


def posts(a: int, small: int) -> bool:
    """Whether a set of a posts to inverted lists: it or a partner of it is above the boundary."""
    return a > small or BOTTOM * a // TOP > small


def boundary(histogram: dict[int, int], scanned: float = 4.0) -> int:
    """The boundary of least cost: a row for each subset, 1 + scanned rows for each posting."""

    def cost(small: int) -> float:
        listed = sum(n * math.comb(a, c) for a, n in histogram.items() if a <= small for c in subset_sizes(a, small))
        return listed + (1 + scanned) * sum(n * posted(a) for a, n in histogram.items() if posts(a, small))

    return min(range(MOST_SMALL + 1), key=lambda x: (cost(x), x))


def _signatures(buckets: int, small: int, shared):
    """Rows (bucket, signatures, ids, sizes) with packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        heavy, parts_of = shared.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found: list[tuple] = []
            total = 0
            for i, s in sets(b.column(1)):
                a = len(s)
                if not a or (key := content_key(s)) in seen:
                    continue
                if len(seen) < MOST_SEEN:
                    seen.add(key)
                for c in subset_sizes(a, small):
                    chosen = mix(s)[np.array(list(combinations(range(a), c)))]
                    found.append((mix(chosen.sum(axis=1, dtype=U) + U(c)), ids[i], -(a << 6 | c)))
                    total += len(chosen)
                if posts(a, small):
                    parts = np.ones(a, np.int64)
                    if len(heavy):
                        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        late = heavy[at] == s
                        parts = np.concatenate((parts[~late], parts_of[at[late]]))
                        s = np.concatenate((s[~late], s[late]))
                    s, parts = s[: posted(a)], parts[: posted(a)]
                    found.append((s[parts == 1], ids[i], a))
                    if (parts > 1).any():
                        found.append((s[parts > 1], ids[i], a | SPLIT, parts[parts > 1]))
                    total += posted(a)
                if total > 200_000:
                    yield _packed(found, buckets)
                    found, total = [], 0
            if found:
                yield _packed(found, buckets)

    return run


def _packed(found: list[tuple], buckets: int) -> pa.RecordBatch:
    n = [len(x[0]) for x in found]
    sig = np.concatenate([x[0] for x in found])
    ids, size = np.repeat(np.array([x[1] for x in found], np.int64), n), np.repeat(np.array([x[2] for x in found], np.int32), n)
    # a member of a split list goes to one of its parts, another one for each shingle, so parts of a group of near copies are linked by its other shingles
    parts = np.concatenate([x[3] if len(x) > 3 else np.ones(len(x[0]), np.int64) for x in found]).astype(U)
    part = mix(sig ^ mix(ids.view(U))) % parts
    to = (np.where(parts > 1, mix(sig + part), sig) % U(buckets)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    sig, ids, size, to = sig[order], ids[order], size[order], to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    edges = [0, *cuts.tolist(), len(to)]
    pack = lambda x: [x[p:q].tobytes() for p, q in zip(edges, edges[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(to[edges[:-1]]), pa.array(pack(sig), pa.binary()), pa.array(pack(ids), pa.binary()), pa.array(pack(size), pa.binary())], ["bucket", "sigs", "ids", "sizes"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket in by_bucket(batches, 0):
        yield from _lists_of(bucket)


def _lists_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of a bucket: kind 0 a pair (member, least member) with their sizes and how many lists of two and of more they share so; kind 1 a member of a list of three or more, or of any part of a split list."""
    parts: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        for i in range(b.num_rows):
            parts.append(tuple(np.frombuffer(b.column(k)[i].as_buffer(), t) for k, t in ((1, np.uint64), (2, np.int64), (3, np.int32))))
    if not parts:
        return
    sig, ids, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
    del parts
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    same = np.empty(len(sig), bool)
    same[0], same[1:] = False, sig[1:] == sig[:-1]
    keep = same.copy()
    keep[:-1] |= same[1:]
    keep |= size[order] >= SPLIT  # alone in its part, but not in its list
    sig, ids, size = sig[keep], ids[order][keep], size[order][keep]
    if not len(sig):
        return
    order = np.lexsort((size, ids, sig))
    sig, ids, size = sig[order], ids[order], size[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1]) | (size[1:] != size[:-1])
    sig, ids, size = sig[fresh], ids[fresh], size[fresh]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(head)
    n = np.diff(np.append(at, len(sig)))
    of = np.repeat(np.arange(len(at)), n)
    # each member with the least one
    first = at[of]
    subset, split = np.where(size < 0, -size & 0x3F, 0), size >= SPLIT
    bare = np.where(size < 0, -size >> 6, size & (SPLIT - 1)).astype(np.int64)
    ok = ~head & (ids != ids[first])
    a, b = bare[first], bare
    ok &= (BOTTOM * np.minimum(a, b) >= TOP * np.maximum(a, b))
    # a shared subset is a link if it is as large as these sizes need; it counts for any number of shared shingles
    sure = ok & (subset > 0) & ((BOTTOM + TOP) * subset >= TOP * (a + b))
    ok &= (subset == 0) | sure
    x, y, sx, sy = ids[ok], ids[first][ok], b[ok], a[ok]
    two = (n[of][ok] == 2) * np.where(sure[ok], 1 << 20, 1)
    more = (n[of][ok] > 2) * np.where(sure[ok], 1 << 20, 1)
    if len(x):
        order = np.lexsort((sy, sx, y, x))
        x, y, sx, sy, two, more = (v[order] for v in (x, y, sx, sy, two, more))
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (sx[1:] != sx[:-1]) | (sy[1:] != sy[:-1])
        at = np.flatnonzero(new)
        yield _rows(0, x[at], y[at], sx[at], sy[at], np.add.reduceat(two, at), np.add.reduceat(more, at))
    long = (n[of] > 2) | split
    if long.any():
        for p in range(0, int(long.sum()), 500_000):
            cut = np.flatnonzero(long)[p : p + 500_000]
            yield _rows(1, ids[cut], sig[cut].view(np.int64), bare[cut], subset[cut], np.zeros(len(cut)), np.zeros(len(cut)))


def _rows(kind: int, x, y, sx, sy, two, more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), pa.array(x), pa.array(y), pa.array(sx.astype(np.int32)), pa.array(sy.astype(np.int32)), pa.array(two.astype(np.int64)), pa.array(more.astype(np.int64))], ["kind", "x", "y", "sx", "sy", "two", "more"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id, size of its set, BITS bits of which each shingle sets one."""
    for b in batches:
        size, bits = [], []
        for _, s in sets(b.column(1)):
            flags = np.zeros(BITS, bool)
            flags[(mix(s) % U(BITS)).astype(np.int64)] = True
            size.append(len(s))
            bits.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int32()), pa.array(bits, pa.binary())], ["id", "size", "bits"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (leader, i, j, block, rep, label, size, bits, lists, subsets): pairs of members of blocks i and j whose labels differ, with how many lists they share.

    A pair is left out if the bits that both have set, and the shingles that share a bit with another of their set, are too few for the threshold. No bits are known of an id that has several texts."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {k: t.column(k).to_numpy() for k in ("block", "rep", "label", "size")}
        known = [x for x in t.column("bits").to_pylist()]
        words = np.stack([np.frombuffer(x or bytes([255]) * (BITS // 8), np.uint64) for x in known])
        extra = np.where([x is None for x in known], 1 << 40, c["size"] - np.bitwise_count(words).sum(axis=1, dtype=np.int64))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(c["block"] == i), np.flatnonzero(c["block"] == j)
        a, b = c["size"][left][:, None].astype(np.int64), c["size"][right][None, :].astype(np.int64)
        ok = (c["label"][left][:, None] != c["label"][right][None, :]) & (BOTTOM * np.minimum(a, b) >= TOP * np.maximum(a, b))
        if i == j:
            ok &= c["rep"][left][:, None] < c["rep"][right][None, :]
        if not ok.any():
            return
        most = np.zeros(ok.shape, np.int32)
        for w in range(words.shape[1]):
            most += np.bitwise_count(words[left, w][:, None] & words[right, w][None, :])
        ok &= (BOTTOM + TOP) * (most + np.minimum(extra[left][:, None], extra[right][None, :])) >= TOP * (a + b)
        if not ok.any():
            return
        # members of each list on both sides
        lists, subsets = (t.column(k).combine_chunks() for k in ("lists", "subsets"))
        own = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        flat = np.stack((lists.flatten().to_numpy(), subsets.flatten().to_numpy().astype(np.int64)), axis=1)
        order = np.lexsort((own, flat[:, 1], flat[:, 0]))
        own, flat = own[order], flat[order]
        at = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]).any(axis=1)))
        place_left, place_right = np.full(t.num_rows, -1), np.full(t.num_rows, -1)
        place_left[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
        shared = np.zeros(ok.shape, np.int64)
        for p, q in zip(at, np.append(at[1:], len(own)), strict=True):
            u, v = place_left[own[p:q]], place_right[own[p:q]]
            cell = np.ix_(u[u >= 0], v[v >= 0])
            subset = int(flat[p, 1])
            # a shared subset is a link if it is as large as these sizes need, and tells nothing otherwise
            shared[cell] += ((BOTTOM + TOP) * subset >= TOP * (a[cell[0]][:, :, 0] + b[0][cell[1]])) * (1 << 20) if subset else 1
        u, v = np.nonzero(ok & (shared > 0))
        if len(u):
            x, y, sx, sy = c["rep"][left[u]], c["rep"][right[v]], c["size"][left[u]], c["size"][right[v]]
            turn = x < y  # x is the greater id, as in round one
            yield _rows(0, np.where(turn, y, x), np.where(turn, x, y), np.where(turn, sy, sx), np.where(turn, sx, sy), np.zeros(len(u)), shared[u, v])

    carry: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        keys = [t.column(k).to_numpy() for k in ("leader", "i", "j")]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        if carry:
            new[0] = any(carry[-1].column(k)[-1].as_py() != t.column(k)[0].as_py() for k in ("leader", "i", "j"))
        at = np.append(np.flatnonzero(new), t.num_rows)
        if at[0]:  # the start goes on with the group before
            carry.append(t.slice(0, at[0]))
        for p, q in zip(at, at[1:], strict=False):
            if carry:
                yield from pairs(pa.concat_tables(carry))
            carry = [t.slice(p, q - p)]
    if carry:
        yield from pairs(pa.concat_tables(carry))


_PAIRS = "kind tinyint, x bigint, y bigint, sx int, sy int, two bigint, more bigint"


def _possible(n):
    """Whether n shared posted shingles can still reach the threshold: all shingles that are not posted may be common too."""
    unposted = lambda s: F.ceil(TOP * F.col(s).cast("long") / F.lit(float(BOTTOM))) - 1
    return (BOTTOM + TOP) * (n + F.greatest(unposted("sx"), unposted("sy"))) >= TOP * (F.col("sx").cast("long") + F.col("sy"))


def _possible_between(n):
    """_possible for any partner from low to high: without rounding up, the bound is least at a partner of the same size and grows to both ends, so the ends tell for all between."""
    nearest = lambda c: F.greatest(F.least(F.col(c), F.floor(F.col("sx") * BOTTOM / TOP)), F.ceil(F.col("sx") * TOP / BOTTOM)).cast("long")
    at = lambda sy: (BOTTOM + TOP) * (BOTTOM * n + TOP * F.greatest(F.col("sx").cast("long"), sy)) >= TOP * BOTTOM * (F.col("sx").cast("long") + sy)
    return at(nearest("low")) | at(nearest("high"))


def fetch(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (id, text) of docs whose id is in ids (one column id). A filter of bounded size drops most others before they are shuffled; ids is read twice, so keep what is dear."""
    spark = docs.sparkSession
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (8 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    words = ids.select(place("id").alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)  # at most 16 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            p = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            hit = (table[p >> U(6)] >> (p & U(63))) & U(1)
            yield b.select([0, 1]).filter(pa.array(hit.astype(bool)))

    some = docs.select("id", "text", place("id").alias("p")).mapInArrow(lean(run), "id bigint, text string")
    return some.join(ids, "id", "left_semi")


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (x, y) of which the sets of shingles reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # sets by text, as rows that share an id may have different ones
        for b in batches:
            ok = []
            y_text = b.column(3)
            for i, own in sets(b.column(2)):
                key = hashlib.blake2b(y_text[i].as_buffer() or b"", digest_size=16).digest()
                other = known.get(key)
                if other is None:
                    if len(known) > 64:
                        known.clear()
                    other = known[key] = next(s for _, s in sets(y_text.slice(i, 1)))
                common = len(np.intersect1d(own, other, assume_unique=True))
                ok.append(common > 0 and BOTTOM * common >= TOP * (len(own) + len(other) - common))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    t = texts.withColumnRenamed("id", "_id")
    full = pairs.select("x", "y").join(t.withColumnRenamed("text", "tx"), F.col("x") == F.col("_id")).drop("_id")
    full = full.join(t.withColumnRenamed("text", "ty"), F.col("y") == F.col("_id")).select("x", "y", "tx", "ty")
    return full.mapInArrow(lean(run), "x bigint, y bigint").distinct()


def _mixed(members: DataFrame) -> DataFrame:
    """Rows (list, subset, rep, label, size) of lists that have several labels, with the least member of their list."""
    mixed = members.groupBy("list", "subset").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("rep").alias("leader")).where("least <> most")
    return members.join(mixed.select("list", "subset", "leader"), ["list", "subset"])


def compare_with_components(tests: DataFrame, members: DataFrame, sizes: DataFrame, docs: DataFrame, work: Work) -> DataFrame:
    """tests (x, to): one link (u, v) for each block of a component in which x reaches the threshold with a member. members: rep, label; sizes: label, shingles.

    A component is dealt over blocks of about BLOCK_SHINGLES shingles; what is tested against it goes to each. Counts of common shingles come from an
    index of the block, so pairs are never written out."""
    blocks = sizes.select("label", F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = members.join(blocks, "label").select("label", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.col("rep").alias("id"), F.lit(0).alias("test"))
    asked = tests.join(blocks, tests["to"] == blocks["label"]).select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("x").alias("id"), F.lit(1).alias("test"))
    texts = work.keep(fetch(docs, work.keep(own.select("id").union(asked.select("id")).distinct(), "ids")), "texts")
    rows = own.union(asked).join(texts, "id").select("label", "block", "test", "id", "text")
    parts = buckets_for(docs.sparkSession, 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, index, held = None, None, []

        def build() -> tuple:
            shingles = np.concatenate([s for _, s in held] or [np.zeros(0, U)])
            owner = np.repeat(np.arange(len(held)), [len(s) for _, s in held])
            order = np.argsort(shingles, kind="stable")
            return shingles[order], owner[order], np.array([len(s) for _, s in held]), [i for i, _ in held]

        for b in batches:
            labels, blocks, test, ids = (b.column(k).to_pylist() for k in range(4))
            u, v = [], []
            for i, s in sets(b.column(4)):
                if (labels[i], blocks[i]) != group:
                    group, index, held = (labels[i], blocks[i]), None, []
                if not test[i]:
                    held.append((ids[i], s))
                    continue
                if index is None:
                    index = build()
                shingles, owner, n, names = index
                low, high = np.searchsorted(shingles, s, "left"), np.searchsorted(shingles, s, "right")
                width = high - low
                at = np.repeat(low - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
                common = np.bincount(owner[at], minlength=len(n))
                hit = np.flatnonzero((common > 0) & (BOTTOM * common >= TOP * (len(s) + n - common)))
                if len(hit):
                    u.append(ids[i])
                    v.append(names[hit[0]])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.repartition(parts, "label", "block").sortWithinPartitions("label", "block", "test", "id").mapInArrow(lean(run), "u bigint, v bigint")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for every row of docs with an id."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Work(spark, "near")
    docs = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).where("id IS NOT NULL")

    profile = work.keep(docs.mapInArrow(lean(_profile), "kind tinyint, a bigint, n bigint, k1 bigint, k2 bigint"), "profile")
    rows = profile.where("kind = 0").select(F.col("a").alias("id"), "n", "k1", "k2")
    frequent = profile.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY).orderBy(F.desc("n"), "a").limit(MOST_HEAVY).toPandas()
    shingles, often = frequent["a"].to_numpy(np.int64).view(U), frequent["n"].to_numpy(np.int64)
    order = np.argsort(shingles)
    heavy = spark.sparkContext.broadcast((shingles[order], 1 + often[order] // PART))  # at most 16 * MOST_HEAVY bytes
    sizes = {r.n: r.c for r in rows.where(f"n BETWEEN 1 AND {2 * MOST_SMALL}").groupBy("n").agg(F.count("*").alias("c")).collect()}
    small = boundary(sizes)
    total = rows.count()

    # documents of one content: the least id stands for all
    # (kept, so that the join below has plain shuffles on both sides, of which a large group of copies can be split)
    first = work.keep(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep")), "first")
    members = work.keep(rows.where("n > 0").join(first, ["k1", "k2"]).select("id", "rep", "n"), "members")
    twice = members.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u <> v").select("u", "v")

    buckets = buckets_for(spark, total, 4096)
    signatures = docs.mapInArrow(lean(_signatures(buckets, small, heavy)), "bucket int, sigs binary, ids binary, sizes binary")
    lists = work.keep(signatures.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_lists), _PAIRS), "lists")

    # round one: each member of a list with the least
    stands = members.groupBy("id").agg(F.min("rep").alias("rep"))
    as_reps = lambda p: (
        p.join(stands.select(F.col("id").alias("x"), F.col("rep").alias("rx")), "x").join(stands.select(F.col("id").alias("y"), F.col("rep").alias("ry")), "y")
        .where("rx <> ry")
        .groupBy(F.greatest("rx", "ry").alias("x"), F.least("rx", "ry").alias("y"))
    )
    # sizes and counts of two copies of a document are alike, up to lists that one of them missed: the most counts
    one = lists.where("kind = 0").groupBy("x", "y", "sx", "sy").agg(F.sum("two").alias("two"), F.sum("more").alias("more"))
    one = as_reps(one).agg(F.max("sx").alias("sx"), F.max("sy").alias("sy"), F.sum("two").alias("two"), F.sum("more").alias("more"))
    one = work.keep(one, "one")
    tried = one.where(_possible(F.col("two") + F.col("more"))).select("x", "y")
    ids = lambda p: p.select(F.col("x").alias("id")).union(p.select("y")).distinct()
    links = work.keep(compare(tried, work.keep(fetch(docs, ids(tried)), "texts")).select(F.col("x").alias("u"), F.col("y").alias("v")).union(twice), "links")
    labels = connected_components(links, work)

    # lists of three or more whose members are still in different components
    places = lambda now: stands.select("rep").distinct().join(now, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("label", "rep").alias("label"))
    at = work.keep(places(labels), "at")
    long = lists.where("kind = 1").select(F.col("x").alias("id"), F.col("y").alias("list"), F.col("sx").alias("size"), F.col("sy").alias("subset"))
    long = long.join(stands, "id").join(at, "rep").select("list", "subset", "rep", "label", "size").distinct()
    left = work.keep(_mixed(long), "left")

    # round two: members against whole components that are large
    large = work.keep(at.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE), "large")
    if not large.isEmpty():
        held = left.join(large.select("label"), "label").groupBy("list", "subset", F.col("label").alias("to")).agg(F.min("size").alias("low"), F.max("size").alias("high"))
        meets = left.join(large.select("label", F.lit(True).alias("is_large")), "label", "left").join(held, ["list", "subset"])
        meets = meets.where((F.col("label") != F.col("to")) & (F.col("is_large").isNull() | (F.col("label") > F.col("to"))))
        meets = meets.where((BOTTOM * F.col("high").cast("long") >= TOP * F.col("size")) & (BOTTOM * F.col("size").cast("long") >= TOP * F.col("low")))
        sure = F.max(F.col("subset") > 0).cast("int") * (1 << 20)
        meets = meets.groupBy(F.col("rep").alias("x"), "to").agg((F.count("*") + sure).alias("n"), F.max("size").alias("sx"), F.min("low").alias("low"), F.max("high").alias("high"))
        pairs = one.where("two > 0")
        ways = pairs.select("x", "y", "two").union(pairs.select("y", "x", "two")).toDF("x", "rep", "two")
        by_two = ways.join(at, "rep").join(large.select("label"), "label").groupBy("x", F.col("label").alias("to")).agg(F.sum("two").alias("two"))
        meets = meets.join(by_two, ["x", "to"], "left").withColumn("n", F.col("n") + F.coalesce("two", F.lit(0)))
        tests = work.keep(meets.where(_possible_between(F.col("n"))).select("x", "to").distinct(), "tests")
        inside = work.keep(at.join(tests.select(F.col("to").alias("label")).distinct(), "label", "left_semi"), "inside")
        shingles = inside.join(members.select(F.col("id").alias("rep"), "n"), "rep").groupBy("label").agg(F.sum("n").alias("shingles"))
        found = work.keep(compare_with_components(tests, inside, shingles, docs, work), "found")
        labels = connected_components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(found), work)

    # round three: members of small components with each other
    rest = left.join(large.select("label"), "label", "left_anti").drop("label").join(places(labels), "rep").select("list", "subset", "rep", "label", "size")
    left = work.keep(_mixed(rest), "left")
    if not left.isEmpty():
        # lists of one least member go to one place, where their pairs are counted together
        own = left.groupBy("leader", "rep", "label", "size").agg(F.collect_list("list").alias("lists"), F.collect_list("subset").alias("subsets"))  # at most what a text posts
        own = work.keep(own, "own")
        blocks = own.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        texts = fetch(docs, own.select(F.col("rep").alias("id")).distinct())
        bits = texts.mapInArrow(lean(_bits), "id bigint, size int, bits binary").groupBy("id").agg(F.when(F.min("bits") == F.max("bits"), F.min("bits")).alias("bits"))
        others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
        dealt = own.join(bits, F.col("rep") == F.col("id")).join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("to", F.explode(others))
        dealt = dealt.select("leader", F.col("to.i").alias("i"), F.col("to.j").alias("j"), "block", "rep", "label", "size", "bits", "lists", "subsets")
        dealt = dealt.repartition(buckets, "leader", "i", "j").sortWithinPartitions("leader", "i", "j")
        two = dealt.mapInArrow(lean(_across), _PAIRS).groupBy("x", "y").agg(F.max("sx").alias("sx"), F.max("sy").alias("sy"), F.sum("more").alias("more"))
        two = two.join(one.select("x", "y", "two"), ["x", "y"], "left").where(_possible(F.col("more") + F.coalesce("two", F.lit(0)))).select("x", "y").join(tried, ["x", "y"], "left_anti")
        two = work.keep(two, "two")
        more = work.keep(compare(two, work.keep(fetch(docs, ids(two)), "texts")).select(F.col("x").alias("u"), F.col("y").alias("v")), "links")
        labels = connected_components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(more), work)

    out = members.join(labels, members.rep == labels.node, "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
    bare = rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.union(bare).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but the least id of each component, with all their columns; of rows that share an id one stays. Rows without an id stay."""
    found = components(docs, id_col, text_col)
    goes = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_goes")).distinct()
    left = docs.join(goes, docs[id_col] == goes["_goes"], "left_anti")
    if found.groupBy(id_col).count().where("count > 1").isEmpty():
        return left
    by_text = left.where(F.col(id_col).isNotNull()).withColumn("_h", F.xxhash64(*docs.columns))
    once = by_text.dropDuplicates([id_col, "_h"]).withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("_h"))).where("_n = 1").drop("_h", "_n")
    return once.unionByName(left.where(F.col(id_col).isNull()))
