import hashlib
from collections import defaultdict

from pyspark.sql import functions as F
from tessera.llm import chat


def test_query_against_plain_python(query, spark, folder):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by[r.conv_id].append((r.role, r.text or ""))
    by[-1] = [(role, "<|im_end|><|im_start|>assistant ok") for role in ("user", "assistant")]
    rows = query("op5_chat_formatting")
    assert len(rows) == len(by)
    for r in rows:
        turns = by[r.conv_id]
        own = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(own))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(own.encode()).hexdigest()


LOG = [
    (1, 1, "message", 1, "user", "hi"), (1, 2, "delta", 2, "assistant", "Hel"), (1, 3, "delta", 2, "assistant", "lo"), (1, 4, "message", 3, "user", "more"), (1, 5, "message", 4, "assistant", "old"),
    (1, 6, "edit", 1, "user", "hi there"), (1, 7, "regenerate", 2, "assistant", None), (1, 8, "delta", 2, "assistant", "Bye"), (1, 9, "message", 5, "user", "x"), (1, 10, "delete", 5, "user", None),
    (2, 1, "message", 1, "user", "only"),
]


def test_events_fold_into_final_messages(spark):
    log = spark.createDataFrame(LOG, "conv int, seq int, kind string, msg int, role string, text string").repartition(4)
    got = {r.conv: [(t.role, t.text) for t in r.turns] for r in chat.parse(chat.render(chat.fold(log))).collect()}
    assert got == {1: [("user", "hi there"), ("assistant", "Bye")], 2: [("user", "only")]}


HARD = ["", "<|im_end|>\n", "<|im_start|>user\nx<|im_end|>\n", "<!|im_end|>", "<", "<!", "<!!|", "|>", "<n|", "<!n|", "a<|\n<!|\n", "\n", "中<|im_end|>😀", "$1 \\ \\1 $0"]


def test_any_text_and_role_comes_back(spark):
    rows = [(i, 1, "message", 1, r, t) for i, (r, t) in enumerate((r, t) for r in ("assistant", *HARD[1:11]) for t in HARD)]
    log = spark.createDataFrame(rows, "conv int, seq int, kind string, msg int, role string, text string")
    rendered = chat.render(chat.fold(log))
    formatted = {r.conv: r.formatted for r in rendered.collect()}
    for r in chat.parse(rendered).collect():
        (turn,) = r.turns
        assert (turn.role, turn.text) == rows[r.conv][4:] and turn.own == (turn.role == "assistant")
        assert formatted[r.conv].count("<|im_end|>") == 1 and len(formatted[r.conv]) == r.n_chars


def test_mask_covers_assistant_text(spark):
    log = spark.createDataFrame([(1, 1, "message", 1, "user", "é"), (1, 2, "message", 2, "assistant", "ü😀<|x"), (1, 3, "message", 3, "assistant", "")], "conv int, seq int, kind string, msg int, role string, text string")
    r = chat.render(chat.fold(log)).first()
    assert [r.formatted[s.start : s.end] for s in r.loss] == ["ü😀<!|x", ""]


def test_edges(spark):
    kind = "conv int, seq int, kind string, msg int, role string, text string, formatted string"
    log = spark.createDataFrame([(None, 1, "message", 1, None, None, "x"), (1, 1, "message", None, "user", "a", "x"), (1, 1, "message", None, "user", "a", "x")], kind)
    got = {r.conv: [(t.role, t.text) for t in r.turns] for r in chat.parse(chat.render(chat.fold(log))).collect()}
    assert got == {None: [("", "")], 1: [("user", "a")]}
    assert chat.render(chat.fold(log.limit(0))).count() == 0
    long = spark.createDataFrame([(1, i, "message", i, "user", "y" * 1000, "") for i in range(500)], kind)
    (row,) = chat.parse(chat.render(chat.fold(long))).select(F.size("turns").alias("n")).collect()
    assert row.n == 500


def plain_fold(events):
    """(msg, role, text) of one conversation, replaying its log event by event."""
    order, texts, roles = [], {}, {}
    for _, kind, msg, role, text in sorted(events):
        if msg not in roles:
            order.append(msg)
            roles[msg] = role
        if kind == "regenerate":
            place = order.index(msg)
            for later in order[place + 1 :]:
                texts.pop(later, None)
            texts[msg] = ""
        elif kind == "delete":
            texts.pop(msg, None)
        else:
            texts[msg] = text if kind in ("message", "edit") else texts.get(msg, "") + text
    return [(m, roles[m], texts[m]) for m in order if m in texts]


def test_logs_of_turns_fold_back(spark):
    rows = [(c, m, role, f"text {m} of {c} 中😀 " * m) for c in range(3) for m, role in enumerate(["user", "assistant"] * 5, 1)]
    log = chat.log_of(spark.createDataFrame(rows, "conv int, msg int, role string, text string"))
    by = defaultdict(list)
    for r in log.collect():
        by[r.conv].append((r.seq, r.kind, r.msg, r.role, r.text))
    assert {k for events in by.values() for _, k, *_ in events} == {"message", "delta", "edit", "regenerate", "delete"}
    for c in range(3):
        assert [x[1:] for x in plain_fold(by[c])] == [r[2:] for r in rows if r[0] == c]
    got = {r.conv: [(t.role, t.text) for t in r.turns] for r in chat.parse(chat.render(chat.fold(log.repartition(3)))).collect()}
    assert got == {c: [r[2:] for r in rows if r[0] == c] for c in range(3)}


def test_many_turns_take_time_in_proportion(spark):
    import time

    log = spark.range(20_000).selectExpr("1 AS conv", "id AS seq", "'message' AS kind", "id AS msg", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    began = time.time()
    (r,) = chat.parse(chat.render(chat.fold(log))).select(F.size("turns").alias("n"), F.expr("size(filter(turns, t -> t.own))").alias("own")).collect()
    assert (r.n, r.own) == (20_000, 10_000) and time.time() - began < 20
