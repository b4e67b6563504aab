"""Secret scans by assignment-aware lexing.

Base spans come from three patterns. Beyond them, a text that assigns anything to a sensitive name is lexed as source or configuration: names, strings,
bare words, operators. Assignments become pairs of a name and literals: `name = "..."`, `name: ...`, `name := ...`, `"name" => ...`, `a.b["name"] = ...`,
`--name=...`, `name("...")` as setters, attributes, and `<name>...</name>`. Constants are propagated: an assignment of a name, or of a sum of
names and strings, passes on the literals of these names, whatever they were called where they stand, and however long the chain is. A literal is scored
by the most sensitive name that it reaches and by its looks; those that reach a threshold become spans."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Kinds in their order, base ones first, and the base patterns and least lengths (fixed values of the query contract).
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE = 8
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Words of names and how sensitive they make what is assigned to them.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0, "encryptionkey": 1.0, "signingkey": 1.0, "bearer": 0.9, "auth": 0.7, "authorization": 0.8,
    "dsn": 0.6, "connectionstring": 0.8,
}
#: Pairs of neighbouring words of a name that count as one of SENSITIVE.
PAIRS = {a + b for a, b in (("api", "key"), ("private", "key"), ("access", "key"), ("secret", "key"), ("auth", "key"), ("encryption", "key"), ("signing", "key"), ("connection", "string"))}
#: Words that say that the value is about a secret and none itself.
HARMLESS = frozenset(("count", "length", "len", "size", "limit", "max", "min", "type", "name", "path", "file", "url", "uri", "field", "label", "hint", "policy", "expiry", "expires", "ttl", "prompt", "input", "id"))
PLACEHOLDER = re.compile(
    r"(?i)^(?:.*(?:example|changeme|change[_-]me|placeholder|your[_-]|dummy|redacted|insert[_-]|todo).*|x{4,}|\*+|\.+|-+|(.)\1*|none|null|true|false|undefined|\$\{.*\}|\$\w+|<.*>|\{\{.*\}\}|%\w+%?|process\.env\..*|os\.environ.*)$", re.S
)
LEAST_LITERAL, LEAST_SCORE = 8, 0.5
#: A text where nothing follows a sensitive name that could assign to it is not lexed. All of SENSITIVE's words have one of these parts.
_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "dsn", "string")
_RUN = re.compile(r"([\w.$ -]++)[\"'\]]*+\s*+([:=(>+])?")
_STRING = r"""(?P<string>(?:(?<!\w)|(?<=\b[rbufRBUF])|(?<=\b[rbufRBUF]{2}))(?:"{3}[\s\S]*?"{3}|'{3}[\s\S]*?'{3}|`[^`]*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))|"""
_REST = r"(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*)*)|(?P<op>:=|=>|==|!=|<=|>=|\+=|[=:+(),;\[\]{}<>/&|])|(?P<line>\n)|(?P<space>[^\S\n]+)|(?P<other>[\s\S])"
_LEX, _UNQUOTED = re.compile(_STRING + _REST), re.compile(_REST)
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")


_ELEMENT = re.compile(r"\s*+([^<>]*+)</")
_PREFIX = re.compile(r"[rbufRBUF]{1,2}")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass(frozen=True)
class Literal:
    """A literal's content and place, and whether it was in quotes."""

    text: str
    start: int
    end: int
    quoted: bool


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns: leftmost non-overlapping per kind, failing ones dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def name_words(name: str) -> list[str]:
    """The words of a name, split at cases and other characters, in lower case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def _last(name: str) -> str:
    """The last part of a dotted name."""
    return re.split(r"\.|->|::", name)[-1]


def sensitivity(name: str) -> float:
    """How sensitive what is assigned to a name is, from 0 to 1; the last part of a dotted name counts."""
    words = name_words(_last(name))
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    if any(a + b in PAIRS for a, b in zip(words, words[1:], strict=False)):
        best = 1.0
    return 0.0 if words and words[-1] in HARMLESS else best


def looks(literal: Literal) -> float:
    """How much a literal looks like a secret, from 0 to 1."""
    text = literal.text
    if len(text) < LEAST_LITERAL or PLACEHOLDER.match(text):
        return 0.0
    kinds = sum(bool(re.search(p, text)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9\s]"))
    if not literal.quoted and (kinds < 2 or not re.search(r"[0-9]", text)):
        return 0.0  # a bare word in running text
    n = len(text)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    spaces = len(re.findall(r"\s", text))
    score = 0.4 + 0.1 * kinds + 0.1 * min(bits, 4) / 4 + 0.1 * (n >= 16)
    return 0.0 if bits < 1.5 or 4 * spaces > n else min(score, 1.0)


def lex(text: str) -> Iterator[Token]:
    """The tokens of a text but white space. A quote that its line does not close is a token by itself, as are all of its kind up to the line's end: each
    line is searched once for the end of a string that has none."""
    at, closed = 0, {'"': 0, "'": 0}
    while at < len(text):
        m = (_UNQUOTED if at < closed.get(text[at], 0) else _LEX).match(text, at)
        if m.lastgroup == "other" and m[0] in closed and at >= closed[m[0]]:
            end = text.find("\n", at)
            # a quote after a word was not tried, and says nothing about those to come
            if at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_"):
                closed[m[0]] = end if end >= 0 else len(text)
        if m.lastgroup != "space":
            yield Token(m.lastgroup, m[0], at, m.end())
        at = m.end()


def _content(token: Token) -> Literal:
    """What is within a string token's quotes."""
    mark = 3 if token.text[:3] in ('"""', "'''") and len(token.text) >= 6 else 1
    return Literal(token.text[mark:-mark], token.start + mark, token.end - mark, True)


class Value:
    """What a name stands for: literals of its own and the values of other names. told: the highest weight that they were told with."""

    def __init__(self):
        self.own: list[Literal] = []
        self.parts: list[Value] = []
        self.told = 0.0


class Scanner:
    """Reads a text's assignments in order; `known` has the value of each name so far. Linear in the text: a value is kept once, whoever refers to it, and
    is told again only with a higher weight, of which there are a few."""

    def __init__(self, text: str):
        self.text, self.tokens, self.known = text, list(lex(text)), {}
        self.reached: dict[Literal, tuple[float, str]] = {}
        self.at = 0

    def _kind(self, k: int, kind: str) -> bool:
        return k < len(self.tokens) and self.tokens[k].kind == kind

    def _op(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind == "op" and self.tokens[k].text in texts

    def run(self) -> list[tuple[Literal, float, str]]:
        """The literals that names reach, each with its best score and that name, in the order of the text."""
        while self.at < len(self.tokens):
            token = self.tokens[self.at]
            self.at += 1
            if token.kind == "name":
                self._named(token.text, self.at, quoted=False)
            elif token.kind == "string" and re.fullmatch(r"[\w.$ -]+", inner := _content(token).text):
                self._named(inner, self.at, quoted=True)
        return sorted(((x, s, name) for x, (s, name) in self.reached.items()), key=lambda r: r[0].start)

    def _named(self, name: str, k: int, quoted: bool) -> None:
        """A name stands before token k: reads what is assigned to it, if anything is. A string is a name where `:`, `=`, `=>` or `]` follows."""
        if quoted and self._op(k, "]"):
            k += 1  # a["name"] = ...
        if self._op(k, "=", ":=", "=>", ":", "+="):
            self._assign(name, self._typed(k))
        elif not quoted and self._op(k, "(") and self._op(k + 2, ")", ","):
            value = self._value(k + 1)
            if value is not None and not any(re.search(r"\s", x.text) for x in value.own):
                self._told(name, value)
        elif not quoted and self._op(k, ">") and self._op(k - 2, "<"):
            if m := _ELEMENT.match(self.text, self.tokens[k].end):  # <name>...</name>
                self._told(name, self._literal(m[1].rstrip(), m.start(1), m.start(1) + len(m[1].rstrip()), True))

    def _typed(self, k: int) -> int:
        """The place of the value that an assignment at token k has; in `name: Type = ...` it is after the type."""
        j = k + 1
        if self._op(k, ":") and self._kind(j, "name"):
            while j < k + 12 and (self._kind(j, "name") or self._op(j, "[", "]", ",", "|", "<", ">")):
                j += 1
            if self._op(j, "="):
                return j + 1
        return k + 1

    @staticmethod
    def _literal(text: str, start: int, end: int, quoted: bool) -> Value:
        out = Value()
        out.own.append(Literal(text, start, end, quoted))
        return out

    def _assign(self, name: str, k: int) -> None:
        value = self._value(k)
        if value is not None:
            self.known[name] = self.known[_last(name)] = value
            self._told(name, value)

    def _value(self, k: int) -> Value | None:
        """The value that starts at token k: strings, names that have a value, sums of both, or a bare word."""
        out = Value()
        while k < len(self.tokens):
            token = self.tokens[k]
            if token.kind == "name" and _PREFIX.fullmatch(token.text) and self._kind(k + 1, "string") and self.tokens[k + 1].start == token.end:
                k += 1
                token = self.tokens[k]
            if token.kind == "string":
                out.own.append(_content(token))
            elif token.kind == "name" and token.text in self.known:
                out.parts.append(self.known[token.text])
            elif not out.own and not out.parts and token.kind != "line" and (m := _BARE.match(self.text, token.start)):
                word = m[0].rstrip(".:")
                return self._literal(word, token.start, token.start + len(word), False)
            else:
                break
            if self._op(k + 1, "+", "&"):
                k += 2
            elif token.kind == "string" and self._kind(k + 1, "string"):
                k += 1
            else:
                break
        return out if out.own or out.parts else None

    def _told(self, name: str, value: Value) -> None:
        weight, todo = sensitivity(name), [value]
        while todo:
            value = todo.pop()
            if value.told >= weight:
                continue
            value.told = weight
            todo += value.parts
            for x in value.own:
                score = weight * looks(x)
                if score > self.reached.get(x, (0.0, ""))[0]:
                    self.reached[x] = score, name


def literals(text: str) -> list[tuple[Literal, float, str]]:
    """(literal, score, name) of a text's literals that reach a sensitive name."""
    low = text.lower()
    if not any(s in low for s in _STEMS):
        return []
    named = (m[1].lower() for m in _RUN.finditer(text) if m[2])
    return Scanner(text).run() if any(s in run for run in named for s in _STEMS) else []


def scan_text(text: str | None) -> list[tuple[str, int, int, float, str, str]]:
    """(kind, start, end, score, name, value) of a text's secrets, by start and kind. Base spans have score 1; literals that lie in one are it."""
    if not text:
        return []
    base = base_spans(text)
    out = [(kind, a, b, 1.0, "", text[a:b]) for kind, a, b in base]
    base.sort(key=lambda s: s[1])
    k, reach = 0, -1
    for x, score, name in literals(text):
        while k < len(base) and base[k][1] <= x.start:
            reach = max(reach, base[k][2])
            k += 1
        if score >= LEAST_SCORE and x.end > reach:
            out.append(("literal", x.start, x.end, score, name, x.text))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPAN = "array<struct<kind:string,start:long,end:long,score:double,name:string,value:string>>"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs(doc_id, text): the secrets of its whole text, by start and kind, in code points.

    A null or empty text has none; repeated rows each give a row; an empty table gives none; other columns are not read. Of two spans at one place the
    kind that is listed first comes first. A literal that a base span covers is not told again. Nothing is shuffled."""
    C.arrow_batches(docs.sparkSession, 500)
    names = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("name", pa.string()), ("value", pa.string())]
    kind = pa.list_(pa.struct([pa.field(n, t) for n, t in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip([n for n, _ in names], s, strict=True)) for s in scan_text(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {SPAN}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str):
    return lambda k: k == kind


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and spans of `find`'s rows."""
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
