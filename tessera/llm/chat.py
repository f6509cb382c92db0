"""Chat formatting by event-sourced reconstruction, with DataFrame functions alone.

A log has one event a row: conversation, sequence number, kind, message, role, text. Per conversation the events are sorted by
sequence and folded into final messages:

* ``message``: the whole text of a message; ``delta``: text added to it; ``edit``: its text anew; ``delete``: it goes;
* ``regenerate``: the message starts anew, empty, and everything after it in the conversation goes.

The fold is window passes and an aggregation over one shuffle: for each message only events since its last reset count, and a message is gone if a later regeneration
stands before it in order or its last word is a deletion. Then each conversation is rendered by a template that marks turns; control strings
inside texts are escaped, reversibly, and the loss mask is the list of half-open code-point ranges of assistant texts in the output.

Defined cases: null texts are empty; null roles are empty; ties of sequence order by kind, role, then text; events of a conversation that have no message id are one message;
rows that repeat count each time; an empty log gives no rows; other columns are ignored. One conversation is one output row, so a conversation
must fit in memory as its formatted text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """No ``<|`` is left: each ``<``, any ``!``, any ``n``, ``|`` gets one more ``!`` after the ``<``."""
    return F.regexp_replace(text, r"<(!*)(n?)\|", "<!$1$2|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<!(!*)(n?)\|", "<$1$2|")


def escape_role(role: Column) -> Column:
    """As escape, and a line break is ``<n|``, so that a role is one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n|"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """events: conv, seq, kind, msg, role, text -> conv, place, role, text of the messages that are left, place ascending with gaps. One shuffle, by conversation."""
    text, seq = F.coalesce("text", F.lit("")), F.col("seq").cast("long")
    e = events.select("conv", seq.alias("seq"), "kind", "msg", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).repartition("conv")
    order = F.struct("seq", "kind", "role", "text")
    by_message = Window.partitionBy("conv", "msg")
    upto = by_message.orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    resets = F.col("kind").isin("message", "edit", "regenerate", "delete").cast("int")
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    e = e.withColumns({"era": F.sum(resets).over(upto), "first": F.min(order).over(by_message), "again": again.over(by_message)})
    e = e.withColumn("last_era", F.max("era").over(by_message))
    m = e.where(F.col("era") == F.col("last_era")).groupBy("conv", "msg").agg(
        F.min("first").alias("place"),
        F.max("again").alias("again"),
        F.min_by("role", order).alias("role"),
        F.array_sort(F.collect_list(order)).alias("parts"),
    )
    # a message goes if one that stands before it was regenerated after it began
    before = Window.partitionBy("conv").orderBy(F.col("place.seq")).rangeBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("gone", F.coalesce(F.max("again").over(before) > F.col("place.seq"), F.lit(False)))
    return m.where(~F.col("gone") & (F.col("parts")[0]["kind"] != "delete")).select(
        "conv", "place", F.when(F.col("role") == "", F.col("place.role")).otherwise(F.col("role")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """messages: conv, place, role, text -> conv, formatted, loss ARRAY<STRUCT<start, end>> (code points). Places are running sums over rows, so the work is linear in the turns."""
    head, body, tail = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text")), END + "\n"
    m = messages.select("conv", "place", head.alias("head"), body.alias("body"), (F.col("role") == learn).alias("own"))
    upto = Window.partitionBy("conv").orderBy("place", "head", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("head").cast("long") + F.length("body") + len(tail)
    m = m.withColumn("end", F.sum(size).over(upto) - len(tail))
    turn = F.struct("end", F.concat("head", "body", F.lit(tail)).alias("whole"), "own", (F.col("end") - F.length("body")).alias("start"))
    c = m.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["own"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return c.select("conv", F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"), loss.alias("loss"))


def parse(rendered: DataFrame) -> DataFrame:
    """conv, formatted, loss (a row a conversation) -> conv, n_chars, turns ARRAY<STRUCT<role, text, own>>, by reading formatted and loss alone.

    Turns and ranges of the mask meet as rows in the order of their places, so the work is linear in the turns."""
    tail = END + "\n"
    parts = rendered.select("conv", F.posexplode(F.split("formatted", r"<\|im_end\|>\n")).alias("pos", "part")).where("part <> ''")
    upto = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("end", F.sum(F.length("part").cast("long") + len(tail)).over(upto))
    parts = parts.select("conv", (F.col("end") - len(tail) - F.length("part") + F.instr("part", "\n")).alias("at"), F.lit(1).alias("turn"), "end", "part")
    marks = rendered.select("conv", F.explode("loss.start").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("string").alias("part"))
    by = Window.partitionBy("conv").orderBy("at", "turn")
    own = F.coalesce((F.lag("turn").over(by) == 0) & (F.lag("at").over(by) == F.col("at")), F.lit(False))
    rows = parts.unionByName(marks).withColumn("own", own).where("turn = 1")
    part = F.col("part")
    turn = F.struct(
        "at",
        unescape_role(F.substring_index(F.substring(part, len(START) + 1, 2**31 - 1), "\n", 1)).alias("role"),
        unescape(part.substr(F.instr(part, "\n") + 1, F.length(part))).alias("text"),
        "own",
    )
    found = rows.groupBy("conv").agg(F.max("end").alias("n_chars"), F.array_sort(F.collect_list(turn)).alias("turns"))
    return found.select("conv", "n_chars", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["own"].alias("own"))).alias("turns"))


def log_of(rows: DataFrame) -> DataFrame:
    """rows: conv, msg (number in the conversation), role, text -> a log of events that folds back to them.

    Odd messages are drafted, answered by a stray message, then regenerated in two deltas, which drops the draft and the stray; even ones begin with their second half, get more, and are edited to
    their whole text; every third is followed by a message that is deleted."""
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.length("text") - half)
    none = F.lit("")

    def event(step: int, kind: str, role, text, msg=None):
        return F.struct((8 * F.col("msg") + step).cast("long").alias("seq"), F.lit(kind).alias("kind"), (F.col("msg") if msg is None else msg).cast("long").alias("msg"), role.alias("role"), text.alias("text"))

    role, stray, dropped = F.col("role"), -2 * F.col("msg"), -2 * F.col("msg") - 1
    odd = F.array(event(0, "message", role, second), event(1, "message", F.lit("user"), first, stray), event(2, "delta", none, first, stray), event(3, "regenerate", none, none), event(4, "delta", none, first), event(5, "delta", none, second))
    even = F.array(event(0, "message", role, second), event(1, "delta", none, first), event(2, "edit", none, F.col("text")))
    gone = F.array(event(6, "message", F.lit("user"), first, dropped), event(7, "delete", none, none, dropped))
    given = rows.select("conv", "msg", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    events = F.concat(F.when(F.col("msg") % 2 == 1, odd).otherwise(even), F.when(F.col("msg") % 3 == 0, gone).otherwise(F.slice(gone, 1, 0)))
    return given.select("conv", F.inline(events))
