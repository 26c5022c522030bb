"""Secret scan by assignment-aware lexing.

Three base kinds are plain patterns (`assign`, `access`, `hex`). The method adds `literal` spans: text
that looks like source or configuration is lexed into names, literals and operators; statements of the
forms  name = literal,  name: literal,  "name": literal,  name = other_name  and  literal + literal
become name-literal pairs, constants are propagated from name to name, and each literal is scored
by the most sensitive name it reaches, its length, its alphabet and its entropy.

A value may stand on a later line: line ends are soft after an operator, an opening bracket or a backslash, and
before a +. Brackets are seen through, to every literal of a list that is not itself a name; arguments of a call are
not. Strings in triple quotes or backticks and PEM blocks span lines; what is inside them is lexed too. XML elements
(<name>value</name>) and settings (<add key="name" value="value"/>) are pairs, and strings that are escaped inside
another string (\\"name\\": \\"value\\") are lexed as if they were not. A text is scanned whole, every value once, and no quote
is followed where none closes it, so cost is linear in its length. Null and
empty texts have no spans. Offsets are code points, end exclusive. Repeated rows give repeated results, a
null doc_id stays null, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_CUE = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of names, and how much each says that the value is a secret.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "accesskey": 3.0,
    "privatekey": 3.0, "clientsecret": 3.0, "credential": 2.5, "auth": 1.5, "bearer": 2.5, "signature": 1.0, "salt": 1.0, "key": 1.0,
}
#: Score from which a literal is a secret.
THRESHOLD = 4.0

_STRINGS = {'"': r'"(?:\\.|[^"\\\n])*"|', "'": r"'(?:\\.|[^'\\\n])*'|"}
_REST = (
    r"""`[^`\n]*`)|(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)|(?P<op>:=|=>|==|!=|<=|>=|[=:+,;(){}\[\]])|(?P<bare>[A-Za-z0-9+/_.=@!%&*~^#-]{6,})|(?P<skip>[^\S\n]+|\\[^\S\n]*\n)|(?P<nl>\n)|(?P<other>.)"""
)
#: Tokens where a string in double, and one in single quotes can still be closed, or can't.
_TOKENS = {(d, s): re.compile(f"(?P<str>{_STRINGS['"'] * d}{_STRINGS["'"] * s}{_REST}", re.A) for d in (True, False) for s in (True, False)}
#: Runs are possessive: nothing that follows one of them could begin inside it.
_TAG = re.compile(r"<([A-Za-z_][\w.:-]*+)([^<>]*+)>([^<>]*+)")
_ATTRIBUTE = re.compile(r"""(?<![\w.:-])([\w.:-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""", re.A)
_ESCAPED = re.compile(r'\\"([^"\\\n]*)\\"')
_LONG = re.compile(r'''"{3}(?P<double>.*?)"{3}|'{3}(?P<single>.*?)'{3}|`(?P<tick>[^`]*)`|["']?(?P<pem>-----BEGIN [A-Z0-9 ]+-----(?:(?!-----).)*-----END [A-Z0-9 ]+-----)''', re.A | re.S)
_PEM_EDGE = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----", re.A)
_LINE_END = re.compile(r"[^\S\n]*\n\s*", re.A)
_ASSIGNS = ("=", ":", ":=", "=>")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|changeme|example|your[-_ ].*|none|null|true|false|todo)$", re.A)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then by kind in KINDS' order."""
    found = []
    if _CUE.search(text):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def name_weight(name: str) -> float:
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((w for part, w in SENSITIVE.items() if part in flat), default=0.0)


def unfolded(value: str) -> str:
    """A literal without line ends and, if it is a PEM block, without the block's edges."""
    if "-----" in value and _PEM_EDGE.search(value):
        value = _PEM_EDGE.sub("", value).replace("\\n", "\n").strip()
    return _LINE_END.sub("", value.strip()) if "\n" in value else value


def literal_score(value: str, weight: float) -> float:
    """The score of a literal that reaches a name of this weight; it grows with the weight."""
    if weight <= 0 or len(value) < 6 or _PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return weight + min(entropy(value), 4.5) / 2 + 0.4 * (kinds - 1) + (0.5 if len(value) >= 16 else 0.0) - (1.5 if kinds == 1 and len(value) < 16 else 0.0)


def _last_open(line: str, quote: str) -> int:
    """Where the last quote stands that no backslash escapes; -1 if there is none."""
    at = line.rfind(quote)
    while at >= 0:
        slashes = at - len(line[:at].rstrip("\\")) if line[at - 1 : at] == "\\" else 0
        if slashes % 2 == 0:
            return at
        at = line.rfind(quote, 0, at - slashes)
    return -1


class Lexer:
    """The tokens of a text from any place on. Each line's last closing quotes are found once."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.last = text, 0, -1, (-1, -1)

    def line(self, start: int, end: int) -> tuple[int, int]:
        if (start, end) != (self.start, self.end):
            line = self.text[start:end]
            last = tuple(_last_open(line, q) if "\\" in line else line.rfind(q) for q in "\"'")
            self.start, self.end, self.last = start, end, tuple(start + x if x >= 0 else -1 for x in last)
        return self.last

    def tokens(self, at: int):
        text, size = self.text, len(self.text)
        while at < size:
            inside = self.start <= at <= self.end
            end = self.end if inside else text.find("\n", at) % (size + 1)
            last = self.last if inside else self.line(at, end)
            while at < min(end + 1, size):
                live = (at <= last[0], at <= last[1])
                for m in _TOKENS[live].finditer(text, at, min(end + 1, size)):
                    s = m.start()
                    if live != (s <= last[0], s <= last[1]):
                        at = s
                        break
                    yield m
                    at = m.end()
                    if at > end + 1:
                        break


def values(lexer: Lexer, at: int):
    """What is assigned by the operator that ends at `at`, as (kind, value, start, end)."""
    text = lexer.text
    found, held, j = lexer.tokens(at), [], 0

    def token(j):
        while len(held) <= j:
            m = next(found, None)
            if m is None:
                return None, "", len(text), len(text)
            if m.lastgroup != "skip":
                held.append((m.lastgroup, m.group(), m.start(), m.end()))
        return held[j]

    def soft(j):
        while token(j)[0] == "nl":
            j += 1
        return j

    depth, first, loose, bullets, last = 0, True, False, False, at  # loose: past a line end or a bracket, where names may follow
    j = soft(0)
    while True:
        kind, value, s, e = token(j)
        loose = loose or "\n" in text[last:s]
        last = e
        if kind == "op" and value in "([{":
            depth, loose, j = depth + 1, True, soft(j + 1)
            continue
        if not (kind == "op" and value in ")]}" and depth):
            if kind == "other" and value in "|>" and first:  # a block of YAML
                k = j + 1 + (token(j + 1)[1] in ("-", "+"))
                if token(k)[0] != "nl":
                    return
                j = soft(k)
                continue
            if kind == "other" and value == "-" and loose and not depth and (first or bullets):  # a list of YAML
                bullets, j = True, j + 1
                continue
            if loose and kind in ("name", "str") and token(j + 1)[1] in _ASSIGNS:
                return
            long = _LONG.match(text, s) if kind and value[0] in "\"'`-" and (kind != "str" or value in ('""', "''")) else None
            if long:
                yield "lit", long.group(long.lastgroup), *long.span(long.lastgroup)
                found, held, j, last = lexer.tokens(long.end()), [], -1, long.end()
                if long.lastgroup == "pem" and text[s] in "\"'" and text[last : last + 1] == text[s]:
                    found, last = lexer.tokens(last + 1), last + 1
            elif kind == "str":
                yield "lit", value[1:-1], s + 1, e - 1
            elif kind == "bare" or kind == "name" and not value.isidentifier():
                yield "lit", value, s, e
            elif kind == "name":
                yield "ref", value, s, e
                following, sign = token(j + 1)[:2]
                if first and sign not in ("+", "(", "[") and (not loose or following in (None, "nl") or sign in (",", ";", ")", "]", "}")):
                    yield "lit", value, s, e
            else:
                return
            first = False
            j += 1
        k = soft(j)
        while depth and token(k)[0] == "op" and token(k)[1] in ")]}":
            depth, j = depth - 1, k + 1
            k = soft(j)
        sign = token(k)[1]
        if token(k)[0] == "op" and (sign == "+" or sign == "," and depth):
            j = soft(k + 1)
        elif depth and token(k)[0] == "str" or bullets and sign == "-" and token(j)[0] == "nl":
            j = k
        else:
            return


def pairs(text: str):
    """Assignments as (target, kind, value, start, end): kind is lit or ref; offsets are the value's."""
    offset, lexer, ahead = 0, Lexer(text), Lexer(text)
    for line in text.split("\n"):
        if "=" in line or ":" in line:
            name, end = None, offset + len(line)
            ahead.start, ahead.end, ahead.last = offset, end, lexer.line(offset, end)
            for m in lexer.tokens(offset):
                if m.start() >= end:
                    break
                if m.lastgroup == "skip":
                    continue
                if name and m.group() in _ASSIGNS:
                    for found in values(ahead, m.end()):
                        yield name, *found
                    ahead.start, ahead.end, ahead.last = offset, end, lexer.last
                name = m.group().strip("\"'`") if m.lastgroup in ("name", "str") else None
        offset += len(line) + 1
    if "<" in text:
        yield from _elements(text)


def _elements(text: str):
    """Pairs of XML: an element's name and its text, a setting's key and its value."""
    for m in _TAG.finditer(text):
        body = m[3].strip()
        if body and text.startswith(f"</{m[1]}", m.end()):
            s = m.start(3) + m[3].index(body)
            yield m[1], "lit", body, s, s + len(body)
        if "value" in m[2]:
            found = {a[1].lower(): a for a in _ATTRIBUTE.finditer(m[2])}
            name, value = found.get("key") or found.get("name"), found.get("value")
            if name and value:
                k = 2 if value[2] is not None else 3
                yield name[2] or name[3] or "", "lit", value[k], m.start(2) + value.start(k), m.start(2) + value.end(k)


def reached_weights(sources: dict[str, set[str]]) -> dict[str, float]:
    """The weight of the most sensitive name that each name's value reaches, over any number of names; names that reach
    none are left out. Heaviest first and against the flow, so every name is visited once."""
    best: dict[str, float] = {}
    weights = {n: name_weight(n) for n in sources}
    for name in sorted((n for n, w in weights.items() if w > 0), key=lambda n: -weights[n]):
        stack = [name]
        while stack:
            n = stack.pop()
            if n not in best:
                best[n] = weights[name]
                stack.extend(sources.get(n, ()))
    return best


def literal_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals that reach a sensitive name."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    if '\\"' in text:
        plain, at = [], 0
        for m in Lexer(text).tokens(0):  # a string that holds escaped ones loses its own quotes
            if m.lastgroup == "str" and '\\"' in m.group():
                plain += [text[at : m.start()], " ", m.group()[1:-1], " "]
                at = m.end()
        plain = _ESCAPED.sub(r' "\1" ', "".join(plain) + text[at:])  # as long as the text
        if plain != text:
            return sorted({*_reaching(text), *_reaching(plain)}, key=lambda x: x[1:])
    return _reaching(text)


def _reaching(text: str) -> list[tuple[str, int, int]]:
    literals: dict[tuple[int, int], tuple[str, set[str]]] = {}
    sources: dict[str, set[str]] = {}
    for target, kind, value, s, e in pairs(text):
        sources.setdefault(target, set())
        if kind == "ref":
            sources[target].add(value)
        else:
            literals.setdefault((s, e), (value, set()))[1].add(target)
    reached = reached_weights(sources) if literals else {}
    out = []
    for (s, e), (value, names) in literals.items():
        if e > s and literal_score(unfolded(value), max(reached.get(n, 0.0) for n in names)) >= THRESHOLD:
            out.append(("literal", s, e))
    return sorted(out, key=lambda x: x[1:])


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans: the base ones, and literals that are none of them. By start, then kind."""
    base = base_spans(text)
    covered = sorted((s, e) for _, s, e in base)
    added, k, reach = [], 0, -1
    for span in literal_spans(text):
        while k < len(covered) and covered[k][0] <= span[1]:
            reach = max(reach, covered[k][1])
            k += 1
        if reach < span[2]:
            added.append(span)
    rank = {k: i for i, k in enumerate((*KINDS, "literal"))}
    return sorted(base + added, key=lambda x: (x[1], rank[x[0]], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_literal, base_spans, spans) for every row of docs."""

    def start():
        def step(batch):
            rows = []
            for t in batch.column(1).to_pylist():
                spans = scan(t or "")
                counts = Counter(k for k, _, _ in spans)
                rows.append((*(counts[k] for k in (*KINDS, "literal")), joined([x for x in spans if x[0] != "literal"]), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            return pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_spans", "spans"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_spans string, spans string", start)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_literal")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
