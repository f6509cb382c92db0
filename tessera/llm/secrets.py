"""Secret scan by assignment-aware lexing.

Source and configuration text is lexed into name-literal pairs: ``name = "literal"``, ``name: "literal"``, ``name += "literal"``, calls that take a name and a value, and right-hand sides as a whole (literals side
by side, added, in brackets, in triple quotes, or as what stands in for something else; references to earlier names). A bare word is a literal only where it is the rest of a line of configuration (``NAME=word``, ``key: word``) and
can be no name, path or call. Constants are propagated in the order of the text, and each value is scored by how sensitive the name it reaches is and how random it looks; each literal that flows into a value
so found is a span of its own. Three plain patterns (see BASE) are always reported besides; what lexing adds has the kind ``lexed``.

Defined cases: null and empty texts have no spans; a literal that a plain span covers is not added again;
spans are half-open ranges of code points; rows that repeat are scanned as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.work import lean, small_batches

# The plain patterns, in the order in which kinds are listed, with the length each needs.
BASE = (
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    # a run of 16 or more is the same whether shorter runs are matched and dropped or never matched
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
#: Parts of names that make a literal sensitive, with their weight.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.9, "private": 0.6, "signature": 0.6, "access": 0.5, "key": 0.5, "salt": 0.6, "dsn": 0.6}
#: Least score of a literal that is reported: weight of the name (at most 1) times its randomness (0 to 1).
LEAST_SCORE = 0.35
LEAST_LITERAL = 8

_TOKEN = re.compile(
    r'''(?P<str>"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<op>\+=|:=|=>|==|!=|<=|>=|&&|\|\||\?\?|[=:+;,\n()\[\]{}?])|(?P<word>[A-Za-z0-9_$.][A-Za-z0-9_$./=+-]*)''', re.S
)
#: Words that join operands, or stand before one.
_JOINS = {"or", "and", "if", "else", "not", "await", "new", "const", "return"}
#: What a line of configuration may begin with, calls that take a name and a value, and calls whose second value stands in for what is not there.
_LEADS = {"export", "set", "setx", "env", "ENV", "ARG", "-e", "--env"}
_GIVES = re.compile(r"(?:^|[._])(?:set|put|add|define|with|header|insert|store|save|register|append|option|param|property|get|getenv|environ|env|config)[A-Za-z_]*\Z", re.I)
_GETS = re.compile(r"(?:^|[._])(?:get|getenv|env|environ|config)[A-Za-z_]*\Z", re.I)
_PATH = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|->|::)[A-Za-z_$][A-Za-z0-9_$]*)+\Z")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*\Z")
#: Tokens of a call that are passed over to see what follows it.
MOST_AHEAD = 400
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*\Z")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in {*parts, *joined}))


class Flow:
    """What a name stands for: a literal of the text, or two such values put together. Values are shared, never copied, so that s = s + s costs a node."""

    __slots__ = ("length", "shares", "parts", "span", "told")

    def __init__(self, length: float, shares: dict[str, float], parts: tuple[Flow, ...] = (), span: tuple[int, int] | None = None):
        self.length, self.shares, self.parts, self.span, self.told = length, shares, parts, span, False

    @classmethod
    def literal(cls, value: str, start: int, end: int) -> Flow:
        return cls(len(value), {c: k / len(value) for c, k in Counter(value).items()}, (), (start, end))

    def plus(self, other: Flow) -> Flow:
        if not self.length or not other.length:
            return other if not self.length else self
        n = min(self.length + other.length, 1e300)  # doubled a thousand times it is long enough
        left = self.length / n
        if self is other:
            return Flow(n, self.shares, (self,))
        return Flow(n, {c: left * self.shares.get(c, 0.0) + (1 - left) * other.shares.get(c, 0.0) for c in self.shares | other.shares}, (self, other))

    def spans(self) -> Iterator[tuple[int, int]]:
        """Spans of all literals in it that were not told before, so that telling costs no more than the text has."""
        waiting = [self]
        while waiting:
            now = waiting.pop()
            if not now.told:
                now.told = True
                waiting += now.parts
                if now.span:
                    yield now.span


def randomness(value: Flow) -> float:
    """Bits a character, of the most that so long a value could have, raised by mixed character classes."""
    if value.length < 2:
        return 0.0
    bits = -sum(f * math.log2(f) for f in value.shares.values() if f > 0)
    kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "." for c in value.shares}
    return min(1.0, bits / math.log2(max(4, min(value.length, 64))) * (0.4 + 0.2 * len(kinds)))


def _content(token: tuple[str, str, int, int]) -> Flow:
    """The literal that a string token holds."""
    _, part, s, e = token
    q = 3 if len(part) >= 6 and part[:3] in ('"""', "'''") else 1
    return Flow.literal(part[q:-q], s + q, e - q) if e - s > 2 * q else Flow(0, {})


def _is_op(token: tuple, *ops: str) -> bool:
    return token[0] == "op" and token[1] in ops


_NONE = ("", "", 0, 0)


class Lexed:
    """The tokens of a text, and the values of its right-hand sides."""

    def __init__(self, text: str):
        self.tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        self.known: dict[str, Flow] = {}

    def at(self, i: int) -> tuple[str, str, int, int]:
        return self.tokens[i] if 0 <= i < len(self.tokens) else _NONE

    def _close(self, i: int) -> int:
        """Place of the bracket that closes the one at i, if it is near."""
        depth = 0
        for j in range(i, min(len(self.tokens), i + MOST_AHEAD)):
            depth += _is_op(self.tokens[j], "(", "[", "{") - _is_op(self.tokens[j], ")", "]", "}")
            if not depth:
                return j
        return -1

    def named(self, i: int) -> tuple[str, Flow] | None:
        """(name, value) of the call whose bracket is at i, if it takes these two."""
        if self.at(i + 1)[0] == "str" and _is_op(self.at(i + 2), ",") and self.at(i + 3)[0] == "str" and _is_op(self.at(i + 4), ")"):
            return self.at(i + 1)[1][1:-1], _content(self.at(i + 3))
        return None

    def value(self, i: int) -> tuple[Flow, int]:
        """What the expression from token i on gives, and where to go on: literals that stand side by side, are added, bracketed, or stand in for something else (or, ||, ??, conditions), names for what
        they were last given; other names and calls give nothing. Calls are gone into afterwards, as they may assign names themselves."""
        value, depth, wants, asked, back = Flow(0, {}), 0, True, False, -1
        while i < len(self.tokens):
            token = self.tokens[i]
            kind, part, *_ = token
            if kind == "str":
                value, wants = value.plus(_content(token)), False
            elif kind == "word" and part in _JOINS:
                wants = True
            elif kind == "word":
                if not wants:
                    break
                wants = False
                if _is_op(self.at(i + 1), "(", "[") and part not in self.known:
                    close = self._close(i + 1)
                    back = i + 1 if back < 0 else back
                    given = self.named(i + 1) if _GETS.search(part) else None
                    value = value.plus(given[1]) if given else value
                    if close < 0:
                        break
                    i = close
                elif part in self.known:
                    value = value.plus(self.known[part])
            elif part == "\n":
                if not depth and not (wants and asked):
                    break
            elif part in ("(", "["):
                if not wants:
                    break
                depth += 1
            elif part in (")", "]"):
                if not depth:
                    break
                depth -= 1
            elif part in ("+", "||", "??", "&&", "?") or part == ":" and asked or part == "," and depth:
                wants = asked = True
            else:
                break
            i += 1
        return value, back if back >= 0 else i

    def plain_word(self, first: int, at: int, code: bool) -> Flow | None:
        """The word at token at as a literal: if it is the rest of a line whose name is its first token, and can be no name of something else (code: nor any name at all)."""
        kind, part, s, e = self.at(at)
        before, after = self.at(first - 1), self.at(at + 1)
        leads = before in (_NONE,) or before[1] in ("\n", "{", ",") or before[1] in _LEADS
        if kind != "word" or part in self.known or not leads or after[0] and after[1] not in ("\n", ",", "}"):
            return None
        if _PATH.match(part) or _IDENTIFIER.match(part) and (code or not any(c.isdigit() for c in part)) or not any(c.isalnum() for c in part):
            return None
        return Flow.literal(part, s, e)


def pairs(text: str) -> Iterator[tuple[str, Flow]]:
    """(name, value) of all assignments and calls that take both; a name on the right stands for what it was last given."""
    lexed = Lexed(text)
    known, tokens, i = lexed.known, lexed.tokens, 0
    while i < len(tokens):
        kind, name, start, end = tokens[i]
        op, more = lexed.at(i + 1), False
        if kind == "word" and name.endswith("=") and _NAME.match(name[:-1].rstrip("+:")) and op[0] == "str":  # NAME="literal", NAME+="literal"
            more, name, at = name.endswith("+="), name[:-1].rstrip("+:"), i + 1
        elif kind == "word" and "=" in name:  # NAME=literal
            left, _, right = name.partition("=")
            before, after = lexed.at(i - 1), op
            if right and _NAME.match(left) and (not before[0] or before[1] == "\n" or before[1] in _LEADS) and (not after[0] or after[1] in ("\n", ";")) and not _PATH.match(right):
                known[left] = Flow.literal(right, end - len(right), end)
                yield left, known[left]
            i += 1
            continue
        elif _is_op(op, "=", ":", ":=", "=>", "+=") and (kind == "word" and _NAME.match(name) or kind == "str"):
            more, name, at = op[1] == "+=", name.strip("\"'"), i + 2
        elif kind == "word" and _is_op(op, "(") and _GIVES.search(name) and (given := lexed.named(i + 1)) and _NAME.match(given[0]) and given[1].length:
            yield given
            i += 2
            continue
        else:
            i += 1
            continue
        word = lexed.plain_word(i, at, op[1] in ("=", ":=", "+="))
        value, j = (word, at + 1) if word else lexed.value(at)
        if more and name in known:
            value = known[name].plus(value)
        if value.length:
            known[name] = value
            yield name, value
        i = max(j, i + 1)


def _uncovered(spans: list[tuple[int, int]], plain: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans, by start, that no plain one covers: one sweep over both."""
    waiting, furthest = sorted(plain), -1
    at = 0
    for s, e in sorted(set(spans)):
        while at < len(waiting) and waiting[at][0] <= s:
            furthest = max(furthest, waiting[at][1])
            at += 1
        if furthest < e:
            yield s, e


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kinds in the order of BASE, then lexed ones."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), m.end(), "assign") for m in BASE[0][1].finditer(text) if len(m.group(2)) >= BASE[0][3]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in BASE[1][1].finditer(text) if m.end() - m.start() >= BASE[1][3]]
    found += [(m.start(), m.end(), "hex") for m in BASE[2][1].finditer(text)]
    if "=" in text or ":" in text or '",' in text or "'," in text:
        lexed: list[tuple[int, int]] = []
        for name, value in pairs(text):
            weight = sensitivity(name)
            if weight and not value.told and value.length >= LEAST_LITERAL and weight * randomness(value) >= LEAST_SCORE:
                lexed += value.spans()
        found += [(s, e, "lexed") for s, e in _uncovered(lexed, [(s, e) for s, e, _ in found])]
    order = {k: n for n, k in enumerate(("assign", "access", "hex", "lexed"))}
    return sorted(found, key=lambda x: (x[0], order[x[2]], x[1]))


def scan_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, spans ARRAY<STRUCT<start, end, kind>>. Narrow: no shuffle, one text in memory at a time beside its batch."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, span)], ["id", "spans"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(lean(run), f"id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>").withColumnRenamed("id", id_col)


def masked(text: str, by: str = "*") -> str:
    """The text with each span overwritten by as many by."""
    out, done = [], 0
    for s, e, _ in sorted(scan(text)):
        if e > done:
            out += [text[done : max(s, done)], by * (e - max(s, done))]
            done = e
    return "".join(out) + text[done:] if out else text


def mask_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all spans overwritten, by one narrow pass; null stays null and other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            yield b.set_column(k, b.schema.field(k), pa.array([t if t is None else masked(t) for t in b.column(k).to_pylist()], b.schema.field(k).type))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)


def digest(spans: list[tuple[int, int, str]]) -> tuple[int, int, int, str, str]:
    """Counts of the three plain kinds, SHA-256 over the plain spans, and all spans, each as kind:start:end joined by commas."""
    n = Counter(k for _, _, k in spans)
    plain = ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k != "lexed")
    return n["assign"], n["access"], n["hex"], hashlib.sha256(plain.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
