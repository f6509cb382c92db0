import itertools
import random
import re
import zlib

import numpy as np
import pytest
from tessera.llm import queries, toxicity


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in queries.op6_toxicity(spark, "/root/testdata/sf0.1").collect()}


def test_held_out_accuracy(spark, scored):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in scored.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored.values())
    hits = sum(scored[i].predicted for i, y in held.items() if y)
    false = sum(scored[i].predicted for i, y in held.items() if not y)
    assert hits >= 0.85 * sum(held.values()) and false <= 0.02 * len(held)


@pytest.fixture(scope="module")
def channel(spark):
    return toxicity.Channel(toxicity.trigram_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


@pytest.mark.parametrize("disguised, plain", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("cl0wn,", "clown"), ("l0ser", "loser")])
def test_disguises_are_read(channel, disguised, plain):
    assert plain in toxicity.restored(disguised, channel)


@pytest.mark.parametrize("disguised, plain", [("!diot", "idiot"), ("|diot", "idiot"), ("|oser", "loser"), ("foo|", "fool"), ("foo!", "fool"), ("a$$$", "ass")])
def test_signs_at_the_edge_are_read(spark, disguised, plain):
    words = "idiot loser fool foolish ass assess pass glass"
    own = toxicity.Channel(toxicity.trigram_counts(spark.createDataFrame([(words,)], "text string")))
    assert plain in toxicity.restored(disguised, own)


def test_plain_words_stay(channel):
    assert toxicity.restored("hello,", channel) == ("hello",) and toxicity.restored("12", channel) == ()
    assert list(toxicity.words_of("an i d i o t here", channel, {}))[-1] == ("idiot",)


def test_disguised_toxic_text_scores_like_plain(spark, channel):
    model = toxicity.Model({"idiot$": 5.0}, np.array([-4.0, 1.0, 4.0, 1.0]), channel)
    df = spark.createDataFrame([(1, "you are an idiot"), (2, "you are an 1d10t!"), (3, "you are an i d i o t"), (4, "you are kind")], "doc_id bigint, text string")
    s = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert s[4] < 0.3 < min(s[1], s[2], s[3])


def test_counts_match_plain_python(spark):
    df = spark.createDataFrame([("Ab a",), (None,), ("é",)], "text string")
    c = toxicity.trigram_counts(df)
    assert c[0, 1, 2] == 1 and c[1, 2, 0] == 1 and c[0, 1, 0] == 1 and c[0, 27, 27] == 1 and c.sum() == 6  # the last: a word begins after another


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(edge, labels)
    got = toxicity.score(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, labels.limit(0))
    assert all(r.score < 0.01 for r in toxicity.score(edge, none).collect())


def test_rare_precise_words_are_found_among_many_common_ones(spark):
    """Over 5000 features are in more toxic rows than the words that tell toxic rows apart."""
    letters = "abcdefghijklmnopqr"
    common = [a + b + c + "mn" for a in letters for b in letters for c in letters]
    rows = [(i, " ".join([f"own{chr(97 + i % 26)}{chr(97 + i // 26)}", *common]) + (" zorgle" if i < 6 else " quxate" if i < 20 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i < 20)) for i, _ in rows], "doc_id bigint, toxic int"))
    found = {toxicity._stem(f) for f in model.lexicon}
    assert any("zorgle".startswith(f) for f in found) and any("quxate".startswith(f) for f in found)


def plain_decode(word, channel):
    """The cheapest of all spellings that the lattice allows, each priced letter by letter."""
    found = []
    for choice in itertools.product(*channel.lattice(word)):
        text, cost = "".join(put for put, _ in choice), sum(price for _, price in choice)
        symbols = [0, 0, *map(channel.symbol, text)]
        cost += sum(channel.cost[symbols[i], symbols[i + 1], symbols[i + 2]] if i else 1.0 for i in range(len(text)))
        found.append((cost + channel.cost[symbols[-2], symbols[-1], 0], text))
    return sorted(found)


def disguise(rnd, word):
    marks = {"i": "1!", "o": "0", "e": "3", "a": "@4", "s": "$5", "t": "7+"}
    out = "".join(rnd.choice(marks[c]) if c in marks and rnd.random() < 0.4 else c * rnd.choice((1, 1, 1, 3)) for c in word)
    return ".".join(out) if rnd.random() < 0.2 else out


def test_viterbi_against_all_spellings(channel):
    rnd = random.Random(1)
    for _ in range(400):
        word = disguise(rnd, rnd.choice(["idiot", "loser", "clown", "trash", "ass", "stone", "table", "oats"]))
        found = plain_decode(word, channel)
        got = channel.decode(word)
        assert got in {text for cost, text in found if cost <= found[0][0] + 1e-9}


def test_scores_against_a_plain_scorer(spark, channel):
    lexicon = {"idiot$": 4.0, "^los": 2.5, "trash$": 3.0}
    model, rnd = toxicity.Model(lexicon, np.array([-4.0, 1.0, 4.0, 1.0]), channel), random.Random(2)
    texts = [" ".join(disguise(rnd, w) if rnd.random() < 0.3 else w for w in rnd.choices(["idiot", "loser", "trash", "stone", "table", "lost,", "oats"], k=rnd.randrange(12))) for _ in range(60)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    for i, text in enumerate(texts):
        odds = []
        for token in text.split():
            readings = re.findall(r"[a-z]+", token)
            if not re.fullmatch(r"[a-z]+,?", token) or re.search(r"(.)\1\1", token):
                readings += [plain_decode(x, channel)[0][1] for x in {re.sub(r"^[\W_]+|[\W_]+$", "", token), token.strip(".,;:'\"()[]")} if re.search("[a-z]", x) and toxicity._ODD.search(x)]
            weights = [w for f, w in lexicon.items() for r in readings if (r == f[:-1] if f.endswith("$") else r.startswith(f[1:]))]
            odds += [max(weights)] if weights else []
        z = -4 + np.log1p(len(odds)) + 4 * np.log1p(sum(odds)) + min(1.0, 20 * len(odds) / max(1, len(text.split())))
        assert (got[i].tokens, got[i].hits) == (len(text.split()), len(odds)) and got[i].score == pytest.approx(1 / (1 + np.exp(-z)))


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "zorgle here"), ("b", "kind words")] * 3, "doc_id string, text string")
    model = toxicity.fit(docs, spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, toxic int"))
    assert toxicity.score(docs, model).count() == 6
