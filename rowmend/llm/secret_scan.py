"""Secrets in texts: names and literals parsed from source and configuration syntax, scored by name and literal."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowmend.llm import tables
from rowmend.llm.text import pieces

LEAST_SCORE = 0.5
MOST_NAME, LEAST_LITERAL, MOST_LITERAL = 80, 6, 4096

# The base kinds, their patterns and least lengths, in the order of equal starts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "literal")

# What names say about their values: words that name a secret, and words that name something about one.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authorization": 0.8, "auth": 0.7, "pass": 0.7, "pin": 0.5,
    "signature": 0.5, "salt": 0.5, "cookie": 0.5, "key": 0.4,
}
KEY_OF = {"api", "access", "private", "secret", "signing", "encryption", "master", "account", "storage", "deploy", "license", "ssh"}
ABOUT = {
    "count", "counts", "length", "len", "size", "max", "min", "limit", "name", "names", "field", "label", "path", "file",
    "dir", "url", "uri", "endpoint", "type", "kind", "expiry", "expires", "ttl", "timeout", "policy", "public", "hint",
    "prompt", "id", "ids", "index", "regex", "pattern", "header", "help", "message", "error", "title", "format", "env",
}
PLACEHOLDER = re.compile(
    r"change.?me|placeholder|example|sample|dummy|redacted|your|insert|replace|todo|none|null|true|false|undefined"
    r"|^(?:(.)\1*|[*x.#-]+|<.*>|\$.*|%.*|\{.*\}|env[:.].*)$", re.I | re.S,
)
ELSEWHERE = re.compile(r"env|getenv|environ|input|prompt|read|load|fetch|lookup|get|open|decrypt|vault|random|generate", re.I)

_STRING = r"""(?:[rRbBuUfF@]{0,2}(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`))"""
_NAME = r"[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+)*+"
# ``name =``, ``"name":``, ``name := ``, ``name => ``, ``name: Type =``, ``map["name"] =``, and ``<name>`` before its text.
TARGET = re.compile(
    rf"""(?<![\w$.-])(?:(?P<open><)?(?P<quote>["'`]?)(?P<name>{_NAME})(?P=quote)(?(open)>|(?:\s?\])?[^\S\n]{{0,32}}+
    (?::[^\S\n]{{0,8}}+[\w.]++(?:[\[<][\w., ]*+[\]>])?[?]?[^\S\n]{{0,8}}+(?==[^=>]))?(?:=>|:?=(?![=~>])|:(?![:/])))[^\S\n]{{0,32}}+)""",
    re.X,
)
# ``set_name("literal")`` and ``put("name", "literal")``.
CALL = re.compile(rf"(?<![\w$.-])(?P<name>{_NAME})\((?P<first>{_STRING})(?:[^\S\n]*+,[^\S\n]*+(?P<second>{_STRING}))?")
STRING = re.compile(_STRING, re.S)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>&|]++""")
IDENTIFIER = re.compile(rf"(?:{_NAME})\Z")
JOINT = re.compile(rf"(?:[^\S\n]|\\\n)*+(?P<plus>\+|\.\.?|&)?(?:[^\S\n]|\\?\n[^\S\n]*(?=[+\"'`]))*+(?:(?P<string>{_STRING})|(?P<name>{_NAME}))", re.S)
SETTER = re.compile(r"(?:set|with|add|put|use)(?=[_A-Z])_?|\Anew(?=[A-Z])")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_MARKED = re.compile(r"[=:(<]")


@dataclass(frozen=True)
class Pair:
    """A name, the literal it is given, the literal's code points, and the constants it came through."""

    name: str
    literal: str
    start: int
    end: int
    through: tuple[str, ...] = ()


def _inside(text: str, start: int, end: int) -> tuple[int, int]:
    """The part of a string literal between its quotes."""
    while text[start] not in "\"'`":
        start += 1
    return start + 1, end - 1


class _Parser:
    """Pairs of one text in order; every literal given to a plain name is a constant from there on."""

    def __init__(self, text: str):
        self.text, self.pairs, self.known = text, [], {}

    def _give(self, name: str, parts: list[tuple[str, int, int, tuple[str, ...]]]) -> None:
        literal = "".join(p[0] for p in parts)
        # A literal put together from several is reported where its longest part stands.
        _, start, end, _ = max(parts, key=lambda p: len(p[0]))
        through = tuple(dict.fromkeys(n for p in parts for n in p[3]))
        if literal and len(literal) <= MOST_LITERAL:
            pair = Pair(name, literal, start, end, through)
            self.pairs.append(pair)
            self.known[name] = pair

    def _constant(self, name: str) -> tuple[str, int, int, tuple[str, ...]] | None:
        found = self.known.get(name) or self.known.get(name.rpartition(".")[2])
        return found and (found.literal, found.start, found.end, (*found.through, name))

    def _string(self, match_start: int, match_end: int) -> tuple[str, int, int, tuple[str, ...]]:
        start, end = _inside(self.text, match_start, match_end)
        return self.text[start:end], start, end, ()

    def _joined(self, parts: list, at: int) -> int:
        """Further strings and constants joined to the first part; where they end."""
        while more := JOINT.match(self.text, at):
            if more["string"]:
                parts.append(self._string(*more.span("string")))
            elif more["plus"] and (constant := self._constant(more["name"])):
                parts.append(constant)
            else:
                break
            at = more.end()
        return at

    def _value(self, name: str, at: int, tag: bool) -> int:
        text = self.text
        if tag:
            end = text.find("<", at, at + MOST_LITERAL)
            if end > at and text.startswith(f"</{name}", end) and (body := text[at:end].strip()):
                start = text.index(body, at)
                self._give(name, [(body, start, start + len(body), ())])
            return at
        if found := STRING.match(text, at):
            parts = [self._string(*found.span())]
            end = self._joined(parts, found.end())
            self._give(name, parts)
            return end
        bare = BARE.match(text, at)
        if not bare:
            return at
        word, end = bare[0], bare.end()
        if text[end : end + 1] == "(":
            argument = CALL.match(text, at)
            if argument and not argument["second"] and not ELSEWHERE.search(argument["name"]):
                self._give(name, [self._string(*argument.span("first"))])
            return end
        if IDENTIFIER.match(word) and (constant := self._constant(word)):
            parts = [constant]
            end = self._joined(parts, end)
            self._give(name, parts)
        else:
            word = word.rstrip(".:")
            self._give(name, [(word, at, at + len(word), ())])
        return end

    def _call(self, found: re.Match) -> None:
        first = self._string(*found.span("first"))
        name = SETTER.sub("", found["name"].rpartition(".")[2])
        if found["second"]:
            if IDENTIFIER.match(first[0]):
                self._give(first[0], [self._string(*found.span("second"))])
        elif name != found["name"].rpartition(".")[2]:
            self._give(name, [first])

    def parse(self, start: int, end: int) -> None:
        at = start
        while found := TARGET.search(self.text, at, end):
            at = found.end()
            if len(found["name"]) <= MOST_NAME:
                at = max(at, self._value(found["name"], at, bool(found["open"])))
        for found in CALL.finditer(self.text, start, end):
            self._call(found)


def name_literals(text: str) -> list[Pair]:
    """Names and the literals they are given, in order of the lines.

    Read are assignments, typed or not, entries of maps and of YAML, JSON, INI and
    shell files, keyword arguments, setters, ``put(name, value)`` and XML elements. A value
    that is a name seen before stands for that name's literal; strings joined by ``+``,
    ``.`` or by standing side by side are one literal.
    """
    parser, at = _Parser(text), 0
    for mark in _MARKED.finditer(text):
        if mark.start() < at:
            continue
        start = text.rfind("\n", at, mark.start()) + 1 or at
        end = text.find("\n", mark.start())
        at = len(text) if end < 0 else end
        parser.parse(start, at)
    return parser.pairs


def sensitivity(name: str) -> float:
    """0 to 1: how surely a variable of this name holds a secret."""
    words = [w.lower() for w in _WORD.findall(name)]
    worth = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    for a, b in zip(words, words[1:]):
        if b in ("key", "keys") and a in KEY_OF or (a, b) == ("pass", "phrase"):
            worth = 1.0
    # ``token_count`` is about a token, ``count_token`` is one.
    return worth * (0.25 if words and words[-1] in ABOUT or "public" in words else 1.0)


def strength(literal: str) -> float:
    """0 to 1: how little a literal looks like a word, a number or a placeholder."""
    size = len(literal)
    if size < LEAST_LITERAL or PLACEHOLDER.search(literal) or any(c.isspace() for c in literal.strip()) and size > 64:
        return 0.0
    bits = -sum(n / size * math.log2(n / size) for n in Counter(literal).values())
    classes = sum(any(map(test, literal)) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    plain = literal.isalpha() or literal.replace(".", "").isdigit()
    return min(1.0, bits / 3) * (0.45 if plain else 0.75 if classes < 2 else 1.0) * (0.5 if " " in literal else 1.0)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    name: str | None = None
    score: float = 1.0


def spans_of(text: str, least: float = LEAST_SCORE) -> list[Span]:
    """All spans of a text by start, then kind; ``literal`` spans are the method's own."""
    found = [Span("assign", *m.span(), m[1].lower()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    own: dict[tuple[int, int], Span] = {}
    for pair in name_literals(text):
        score = sensitivity(pair.name)
        if score >= least and (score := score * strength(pair.literal)) >= least:
            best = own.get((pair.start, pair.end))
            if best is None or score > best.score:
                own[pair.start, pair.end] = Span("literal", pair.start, pair.end, pair.name, score)
    return sorted([*found, *own.values()], key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tables.ready(docs)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def findings(docs: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, kind, start, end, name, score)``: a row per span, places in code points, end exclusive."""
    rows = _texts(docs, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            spans = [spans_of(t, least) for t in batch.column("text").to_pylist()]
            owner = pa.array([i for i, own in enumerate(spans) for _ in own], pa.int64())
            each = [s for own in spans for s in own]
            yield pa.record_batch(
                [batch.column("id").take(owner), pa.array([s.kind for s in each], pa.string()),
                 pa.array([s.start for s in each], pa.int64()), pa.array([s.end for s in each], pa.int64()),
                 pa.array([s.name for s in each], pa.string()), pa.array([s.score for s in each], pa.float64())],
                ["id", "kind", "start", "end", "name", "score"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, kind string, start bigint, end bigint, name string, score double")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def scan(docs: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, n_literal, base_sha256, spans, score)``, one row per input row.

    The base kinds are patterns; the ``literal`` spans are literals whose name and content
    together score ``least`` or more, wherever the literal stands. ``score`` is the best of a
    text's spans, 0 without any. Null texts are empty and have no spans, rows that repeat
    are scanned one by one, an empty table gives an empty result, other columns are not
    looked at. Texts are scanned whole, in slices of some megabytes.
    """
    rows = _texts(docs, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out: list[tuple] = []
            for text in batch.column("text").to_pylist():
                spans = spans_of(text, least)
                each = [f"{s.kind}:{s.start}:{s.end}" for s in spans]
                base = ",".join(e for e, s in zip(each, spans) if s.kind != "literal")
                counts = Counter(s.kind for s in spans)
                out.append((*(counts[k] for k in KINDS), _digest(base), ",".join(each), max((s.score for s in spans), default=0.0)))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()])]
            yield pa.record_batch(
                [batch.column("id"), *columns], ["id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans", "score"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        work, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_literal bigint, base_sha256 string, spans string, score double"
    )


def redacted(docs: DataFrame, least: float = LEAST_SCORE, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; spans that overlap are one. Null stays null."""
    tables.ready(docs)

    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            if text is None:
                out.append(None)
                continue
            parts, at = [], 0
            for span in spans_of(text, least):
                if span.end <= at:
                    continue
                if span.start >= at:
                    parts += [text[at : span.start], mark]
                at = span.end
            out.append("".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, F.arrow_udf(clean, "string")(F.col(f"`{text_col}`")))
