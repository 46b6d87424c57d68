"""Secrets by exact patterns plus assignment-aware lexing.

A small lexer reads source and configuration syntax: names (with dotted and bracketed parts), quoted literals with escapes,
bare values, numbers, punctuation, comments.  From its tokens come name-literal pairs (``a = "x"``, ``a: x``, ``"a": "x"``,
``a => 'x'``, ``export A=x``, ``a("x")`` of setters, ``--a x``, XML-like ``a="x"``).  Adjacent literals and ``+`` join; a name bound
to a literal stands for it in later assignments of the document (constants propagate along names, so ``k = "..."; db_password = k`` is
scored); what propagates is a literal's place and its counts of characters, so a constant of any length costs the same, and the parts of a joined value are counted once, when its pair ends: the work is linear.  A pair whose last name part is sensitive scores by that name, its literal's length, character classes and entropy;
pairs that score ``LEAST`` or more become spans of kind ``literal`` unless a base span covers them.

Null text counts as empty; texts without a binding sign have no pairs; repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

KINDS = ("assign", "access", "hex", "literal")
LEAST = 1.0
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Runs shorter than 24 fail, and a greedy run is never matched again in part; this finds just the long ones.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")

#: Sensitive parts of names with their weights.
SENSITIVE = {"password": 2.0, "passwd": 2.0, "pwd": 1.8, "passphrase": 2.0, "secret": 1.8, "token": 1.5, "apikey": 1.8, "key": 0.8, "credential": 1.6, "credentials": 1.6, "auth": 1.2, "private": 0.8, "signature": 0.8, "salt": 0.8, "access": 0.4, "client": 0.2, "bearer": 1.6}
_PLACEHOLDER = re.compile(r"(?i)^(?:none|null|nil|true|false|undefined|changeme|example|your[-_ ].*|x+|\*+|<.*>|\$\{.*\}|%\(.*\).*|todo|test)$")

_TOKENS = r"""(?P<comment>//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\Z))
    |(?P<option>(?<!\S)--[A-Za-z][\w-]*+(?=[ \t]+[^\s-]))
    %s
    |(?P<name>[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+)*+)
    |(?P<number>[0-9][\w.]*+)
    |(?P<bind>:=|=>|==|!=|<=|>=|[=:])
    |(?P<newline>\n)
    |(?P<punct>[^\s\w])"""
_STRINGS = {'"': r'"(?:[^"\\\n]|\\.)*+"', "'": r"'(?:[^'\\\n]|\\.)*+'"}
#: By the quotes that may still open a literal on the line: where one has no end, none of its kind behind it has (what it could have ended at
#: would be its end), so it is not tried again before the line ends.
_LEX = {q: re.compile(_TOKENS % (f"|(?P<string>{'|'.join(_STRINGS[x] for x in q)})" if q else ""), re.X) for q in ("\"'", '"', "'", "")}
_OPTION = re.compile(r"(?<!\S)--[A-Za-z][\w-]*+[ \t]+[^\s-]")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if ("=" in text or ":" in text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def name_weight(name: str) -> float:
    """The sum of the weights of the name's parts: snake, kebab, dotted and camel case all split."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    both = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return sum(SENSITIVE[p] for p in {*parts, *both} if p in SENSITIVE)


def _bins(text: str) -> Counter:
    """Counts of characters: each of ASCII by itself, others in 128 bins by code point, so that no count outgrows 256 entries."""
    return Counter(text) if text.isascii() else Counter(c if c < "\x80" else chr(128 + ord(c) % 128) for c in text)


class Literal:
    """The text of a literal, or of several joined (texts, and constants that stand in them): its length, counts of characters and both ends.

    It is made once for each pair, from all its parts; a constant in it costs its counts, 256 at most, whatever its length.
    """

    __slots__ = ("length", "counts", "head", "tail", "parts")
    ENDS = 64

    def __init__(self, *parts: str | Literal):
        self.parts = parts
        own = "".join(x for x in parts if isinstance(x, str))
        self.length, self.counts = len(own), _bins(own)
        for x, times in Counter(x for x in parts if not isinstance(x, str)).items():
            self.length += times * x.length
            theirs = x.counts.copy() if times == 1 else Counter({c: times * n for c, n in x.counts.items()})
            less, more = sorted((self.counts, theirs), key=len)
            for c, n in less.items():
                more[c] += n
            self.counts = more
        self.head, self.tail = self._end(parts, "head"), self._end(parts[::-1], "tail")

    def _end(self, parts: tuple, which: str) -> str:
        found, size = [], 0
        for x in parts:
            if size >= self.ENDS:
                break
            found.append(x if isinstance(x, str) else getattr(x, which))
            size += len(found[-1])
        return "".join(found)[: self.ENDS] if which == "head" else "".join(found[::-1])[-self.ENDS :]

    def text(self) -> str:
        """The whole text; as long as it is."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += x.parts[::-1]
        return "".join(out)

    def placeholder(self) -> bool:
        if self.length <= self.ENDS:
            return _PLACEHOLDER.match(self.head) is not None
        ends = self.head + self.tail
        return _PLACEHOLDER.match(ends) is not None and (ends[0] in "<$%Yy" or set(self.counts) <= set("xX") or set(self.counts) <= {"*"})


def value_weight(value: Literal | str) -> float:
    """0 for placeholders and short or plain values; rises with entropy and mixed classes to 1."""
    v = Literal(value) if isinstance(value, str) else value
    if v.length < 6 or " " in v.counts or v.placeholder():
        return 0.0
    bits = -sum(c / v.length * math.log2(c / v.length) for c in v.counts.values())
    classes = len({0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in v.counts})
    return min(1.0, bits / 4.0) * min(1.0, 0.4 + 0.2 * classes)


def statements(text: str):
    """(start, end) of the stretches worth lexing: lines with a binding sign, joined to the lines that continue them."""
    start = at = 0
    open_ = False
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if not open_:
            start = at
        binds = "=" in line or ":" in line or '("' in line or "('" in line or (open_ and line.strip() != "") or ("--" in line and _OPTION.search(line) is not None)
        more = binds and line.rstrip()[-1:] in ("+", "\\", "=", ":", "(", ",")
        if binds and not more:
            yield start, end
        elif open_ and not binds:
            yield start, at
        open_ = more
        at = end + 1
    if open_:
        yield start, len(text)


def _lexed(text: str, first: int, last: int):
    """Tokens as (kind, text, start, end)."""
    at, quotes = first, "\"'"
    while m := _LEX[quotes].search(text, at, last):
        kind, tok, at = m.lastgroup, m[0], m.end()
        if kind == "newline":
            quotes = "\"'"
        elif kind == "punct" and tok in quotes and tok in "\"'":
            quotes = quotes.replace(tok, "")
        yield kind, tok, m.start(), at


def _pairs(text: str) -> list[tuple[str, Literal, int, int]]:
    """(name, literal, start, end of the literal) in order, constants propagated; linear in the text.

    Three states: no name; a name (or a quoted key) read; a binding sign read.  In the last one literals, joined by ``+`` or by
    standing side by side, gather until something else closes the pair.
    """
    out: list[tuple[str, Literal, int, int]] = []
    known: dict[str, tuple[Literal, int, int]] = {}
    for first, last in statements(text):
        name, bound, value, joins = "", False, None, False

        def close(name: str, value: list | None) -> None:
            if name and value is not None:
                parts, first, last = value
                known[name] = (parts[0] if len(parts) == 1 and isinstance(parts[0], Literal) else Literal(*parts), first, last)
                out.append((name, *known[name]))

        def as_name(value: list) -> str:
            return text[value[1] : value[2]]

        for kind, tok, start, end in _lexed(text, first, last):
            if kind in ("comment", "newline"):
                continue
            if kind == "option":
                close(name, value)
                name, bound, value, joins = tok[2:], True, None, False
            elif kind == "bind":
                if tok not in ("=", ":", ":=", "=>"):
                    close(name, value)
                    name, bound, value = "", False, None
                elif bound and value is not None and tok == ":":  # a = b: the pair before it ends, what was read is a name
                    close(name, value)
                    name, value = as_name(value), None
                elif bound and value is not None:  # name: kind = literal keeps its name; a = b = literal moves on
                    name, value = (name, None) if name_weight(name) else (as_name(value), None)
                else:
                    bound = bool(name)
                joins = False
            elif kind == "string":
                if bound and value is None:
                    value = [[tok[1:-1]], start + 1, end - 1]
                elif bound:
                    value[0].append(tok[1:-1])
                    value[2] = end - 1
                else:
                    name = tok[1:-1]
                joins = False
            elif kind in ("name", "number"):
                own, *place = known.get(tok) or (tok, start, end)
                if bound and value is None:
                    value = [[own], *place]
                elif bound and (joins or start == value[2]):
                    value[0].append(own)
                    value[2] = value[2] if tok in known else end
                else:
                    close(name, value)
                    name, bound, value = (tok if kind == "name" else ""), False, None
                joins = False
            elif tok == "+" and bound and value is not None:
                joins = True
            elif tok == "(" and name and not bound and name_weight(name):  # a setter: set_password("x")
                bound = True
            elif bound and value is not None and start == value[2] and tok in "/_.-@!#$%^&*~":
                value[0].append(tok)
                value[2] = end
                joins = True
            elif not (tok in "()[]{}\"'" and value is None):
                close(name, value)
                name, bound, value, joins = "", False, None, False
        close(name, value)
    return out


def pairs(text: str) -> list[tuple[str, str, int, int]]:
    """(name, text of the literal, start, end of the literal) in order."""
    return [(name, value.text(), s, e) for name, value, s, e in _pairs(text)]


def scored(text: str) -> list[tuple[int, int, int]]:
    """Literals of sensitive names, as spans of kind ``literal``; each place once."""
    found = {}
    for name, value, s, e in _pairs(text):
        w = name_weight(name)
        if w and w * value_weight(value) >= LEAST:
            found[(s, e)] = True
    return [(s, 3, e) for s, e in found]


def all_spans(text: str) -> tuple[list, list]:
    base = base_spans(text)
    if not ("=" in text or ":" in text or '("' in text or "('" in text or "--" in text):
        return base, []
    out, first = [], 0
    for s, k, e in sorted(scored(text)):
        while first < len(base) and base[first][2] <= s:
            first += 1
        if not any(b[0] < e and b[2] > s for b in base[first : first + 3]):
            out.append((s, k, e))
    return base, out


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per document: counts of base spans, their digest, and all spans.  One pass, no exchange."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_literal", pa.int64())])

    def run(batches):
        for b in batches:
            cols: list[list] = [b.column("doc_id").to_pylist(), [], [], [], [], [], []]
            for text in b.column("text").to_pylist():
                base, more = all_spans(text)
                for k in range(3):
                    cols[1 + k].append(sum(x[1] == k for x in base))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(sorted(base + more)))
                cols[6].append(len(more))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return texts(docs).mapInArrow(run, SCHEMA)
