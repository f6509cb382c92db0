import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tessera.llm import packing
from tessera.llm.tokens import Encoder
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, ids, capacity=1024):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for i, own in by.items():
        place = 0
        for n, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, place) and r.ids_crc32 == zlib.crc32(np.array(ids[i][place : place + r.length], "<u4").tobytes())
            assert n == 0 or r.length == capacity
            place += r.length
        assert place == len(ids[i])
    for own in seq.values():
        place = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= capacity
    return len(seq)


def test_query_against_the_tokenizer(query, texts, tokenizer):
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts.items()}
    n = check(query("op7_best_fit_packing"), ids)
    assert n <= 1.02 * -(-sum(map(len, ids.values())) // 1024) + 1


def test_fast_ids_equal_the_tokenizers(texts, tokenizer):
    e, rnd = Encoder(PATH), random.Random(1)
    assert e.fast is not None
    odd = ["".join(rnd.choice("aé \n\t   ıK　中文'sllʼ123½٣😀\x85​.!<|endoftext|>") for _ in range(rnd.randrange(40))) for _ in range(2000)]
    for t in [*list(texts.values())[:50], *odd, "a <|endoftext|> b", "x" * 9000, " " * 9000, ""]:
        assert np.frombuffer(e.one(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def brute_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps), Counter(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_sweep_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    lengths = [rnd.randint(1, 40 if seed % 2 else 12) for _ in range(rnd.randrange(400))]
    plan, *_ = packing.sweep(dict(Counter(lengths)), 40)
    used = Counter()
    for length, _, n, first, _ in plan:
        for k in range(first, first + n):
            used[k] += length
    n, gaps = brute_best_fit(lengths, 40)
    assert len(used) == n and Counter(40 - u for u in used.values()) == gaps


def lengths_table(spark, lengths):
    return spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint, label string")


def used_of(rows):
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        place = 0
        for offset, n in sorted(own):
            assert offset == place
            place += n
    return Counter(40 - sum(n for _, n in own) for own in used.values())


@pytest.mark.parametrize("seed, most", [(1, 40), (2, 12), (3, 3), (4, 40)])
def test_rounds_are_best_fit_decreasing(spark, seed, most):
    """All rounds in one lane give what best fit one piece at a time gives."""
    rnd = random.Random(seed)
    lengths = [rnd.randint(1, most) for _ in range(500)]
    rows = packing.pack(lengths_table(spark, lengths), 40).collect()
    n, gaps = brute_best_fit(lengths, 40)
    assert len(rows) == 500 and used_of(rows) == gaps
    whole, _, opened = packing.sweep(dict(Counter(lengths)), 40)
    assert opened == n == len({r.sequence_id for r in rows})


def test_lanes_cost_little(spark, monkeypatch):
    rnd = random.Random(7)
    lengths = [rnd.choice([40, 40, *range(1, 40)]) for _ in range(2000)]
    one = used_of(packing.pack(lengths_table(spark, lengths), 40).collect())
    monkeypatch.setattr(packing, "LANE_PIECES", 300)
    several = used_of(packing.pack(lengths_table(spark, lengths), 40).collect())
    assert sum(several.values()) <= sum(one.values()) + 3 * 7
    with pytest.raises(ValueError, match="does not fit"):
        packing.pack(lengths_table(spark, [41]), 40)


def test_edges(edge, empty, tokenizer):
    rows = packing.pack_documents(edge.dropDuplicates(["doc_id"]), PATH, 64).collect()
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in edge.collect()}
    check(rows, ids, 64)
    assert packing.pack_documents(empty, PATH).count() == 0
    twice = packing.pack_documents(edge, PATH).where("doc_id = 10").collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    assert list(packing.cut(5, 2)) == [(0, 0, 1), (1, 1, 2), (2, 3, 2)]
    with_ids = packing.pieces(edge, PATH, with_ids=True, keep=("source",)).where("doc_id = 3").first()
    assert np.frombuffer(with_ids.ids, "<u4").tolist() == ids[3] and with_ids.source == "s"
