"""Personal data by a semi-Markov conditional random field over whole-span features.

Four base kinds are plain patterns. The model adds spans of the same kinds in other notations and of
four more (iban, ssn, dob, person). Around every token with a digit or an @, and after every title, it builds a
lattice of candidate segments of at most MAX_TOKENS tokens. A segment may only be of the kinds whose whole-span
rules it keeps (mod 97 and a country's length for iban, Luhn for card, parts for dates and addresses, capital
letters after a title for person); features look at the whole segment (shape, digit count, number of tokens,
cue words before it). The score of a segmentation is the sum of its segments' scores, tokens outside count nothing,
and p(segmentation | text) is its exponential over the sum of all. One dynamic program for each window picks
boundaries and kinds jointly.

Weights maximise the conditional likelihood of sentences made from templates with a fixed seed (forward-backward over
the segment lattice, Adam): they are the same everywhere and a few kilobytes large.

Null and empty texts have no spans. Texts are scanned whole; windows are cut where no trigger is near, and
the cost is linear in the length. A span of the model has at most MAX_TOKENS tokens, which is the method's bound on
entities; base spans have none. Offsets are code points, end exclusive. Repeated rows give repeated
results, a null doc_id stays null, and other columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "dob", "person")
#: Longest segment, and tokens of context at either side of a trigger.
MAX_TOKENS, CONTEXT = 9, 4
SEED, SENTENCES, EPOCHS, RATE, RIDGE = 7, 900, 6, 0.1, 1e-3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match from within a run of digits would also match from its start, hence the look-behind
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIGIT_OR_AT = re.compile("[0-9@]")
#: Titles that announce a person.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Sr Sra Señor Señora Signor Signora"
_TITLES = frozenset(TITLES.split())
_TRIGGER = re.compile(rf"[0-9@]|(?<!\w)(?:{'|'.join(TITLES.split())})(?!\w)")
_TOKEN = re.compile(r"\S+")

#: Letters of an account number by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
#: Words that announce a kind.
CUES = {
    "phone": "phone tel telephone call mobile cell fax whatsapp",
    "card": "card visa mastercard amex credit debit",
    "iban": "iban account bank transfer",
    "ssn": "ssn social security",
    "dob": "born birth dob birthday birthdate",
    "ip": "ip host address server",
    "email": "email mail contact",
}
_CUE = {w: k for k, words in CUES.items() for w in words.split()}
_EDGE = ".,;:!?()[]{}<>\"'|*&%$#"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    if len(s) != IBAN_LENGTHS.get(s[:2]) or not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s, re.A):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > low and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def _part(digits: str) -> bool:
    """Whether a part of an address is at most 255, however many zeros it begins with."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_part(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


_EMAIL = re.compile(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}")
_DATE = re.compile(r"(?:0?[1-9]|[12][0-9]|3[01])([./-])(?:0?[1-9]|1[0-2])\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])")
_SSN = re.compile(r"[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}")
_QUAD = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}")
_PHONE_LIKE = re.compile(r"[+(]?[0-9][0-9 ()./-]+[0-9]")
_NAME = re.compile(r"[^\W\d_]+(?:['’.-][^\W\d_]+)*\.?")


def allowed(segment: str, before: tuple[str, ...]) -> list[int]:
    """Kinds whose whole-span rules a segment keeps; before: the words just before it, the nearest last."""
    if not _DIGIT_OR_AT.search(segment):
        words = segment.split()
        person = bool(before) and before[-1].strip(_EDGE) in _TITLES and len(words) <= 3
        return [KINDS.index("person")] if person and all(w[0].isupper() and _NAME.fullmatch(w) for w in words) else []
    out = []
    if "@" in segment:
        return [KINDS.index("email")] if _EMAIL.fullmatch(segment) else out
    n = len(_DIGIT.findall(segment))
    if 13 <= n <= 19 and re.fullmatch(r"[0-9 -]+", segment) and luhn("".join(_DIGIT.findall(segment))):
        out.append(KINDS.index("card"))
    if n >= 10 and iban_ok(segment):
        out.append(KINDS.index("iban"))
    if n == 9 and _SSN.fullmatch(segment):
        out.append(KINDS.index("ssn"))
    if 6 <= n <= 8 and _DATE.fullmatch(segment):
        out.append(KINDS.index("dob"))
    if n <= 12 and _QUAD.fullmatch(segment) and all(_part(p) for p in segment.split(".")):
        out.append(KINDS.index("ip"))
    if 7 <= n <= 15 and _PHONE_LIKE.fullmatch(segment):
        out.append(KINDS.index("phone"))
    return out


def _shape(s: str) -> str:
    return re.sub("[0-9]+", lambda m: f"{min(len(m.group()), 5)}", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", s)))


def features(segment: str, left: tuple[str, ...], tokens: int) -> list[str]:
    """Whole-segment features; left: the cue kinds found just before it."""
    n = len(_DIGIT.findall(segment))
    out = ["bias", f"tokens {tokens}", f"digits {n}"]
    out += [f"shape {_shape(segment)}"] if n else [f"initials {sum(w.endswith('.') for w in segment.split())}"]
    out += [f"cue {k}" for k in left] or ["no cue"]
    if re.search("[a-z]", segment) and n:
        out.append("letters")
    if re.search("[(+]", segment):
        out.append("dialled")
    return out


class Lattice:
    """The candidate segments of a window: (first token, last token + 1, allowed kinds, features), by end."""

    def __init__(self, tokens: list[tuple[int, int]], text: str):
        words = [text[s:e] for s, e in tokens]
        cues = [_CUE.get(w.strip(_EDGE).lower()) for w in words]
        hot = [bool(_DIGIT_OR_AT.search(w)) for w in words]
        titled = [w.strip(_EDGE) in _TITLES for w in words]
        self.size, self.segments = len(tokens), []
        for j in range(1, self.size + 1):
            for i in range(max(0, j - MAX_TOKENS), j):
                opens = hot[i] or (words[i][:2].isupper() and i + 1 < j) or words[i][0] in "(+" or (i > 0 and titled[i - 1])
                if not opens or not (hot[j - 1] or (i > 0 and titled[i - 1])):
                    continue
                s, e = trimmed(text, tokens[i][0], tokens[j - 1][1])
                if e <= s:
                    continue
                kinds = allowed(text[s:e], tuple(words[max(0, i - 2) : i]))
                if kinds:
                    left = tuple(sorted({c for c in cues[max(0, i - 3) : i] if c}))
                    self.segments.append((i, j, kinds, features(text[s:e], left, j - i)))


class Model:
    """Weights by feature, one for each kind; the outside label's weights are zero."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def scores(self, found: list[str]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in found:
            w = self.weights.get(f)
            if w is not None:
                total += w
        return total

    def scored(self, lattice: Lattice) -> list[tuple[int, int, int, float]]:
        """(first token, last token + 1, kind, score) of every candidate, by end."""
        return [(i, j, k, float(total[k])) for i, j, kinds, found in lattice.segments for total in (self.scores(found),) for k in kinds]

    def decode(self, tokens: list[tuple[int, int]], text: str) -> list[tuple[int, int, int]]:
        """The best segmentation: (first token, last token + 1, kind) of its segments."""
        lattice = Lattice(tokens, text)
        return best(lattice.size, self.scored(lattice)) if lattice.segments else []


def best(size: int, scored: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The segments of the highest-scoring segmentation of `size` tokens."""
    most, back, at = [0.0] * (size + 1), [None] * (size + 1), 0
    for j in range(1, size + 1):
        most[j] = most[j - 1]
        while at < len(scored) and scored[at][1] == j:
            i, _, k, x = scored[at]
            if most[i] + x > most[j]:
                most[j], back[j] = most[i] + x, (i, k)
            at += 1
    out, j = [], size
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((i, j, k))
            j = i
    return out[::-1]


def posteriors(size: int, scored: list[tuple[int, int, int, float]]) -> tuple[float, np.ndarray]:
    """The logarithm of the sum over all segmentations, and each candidate's probability, by forward-backward."""
    ahead, behind = np.zeros(size + 1), np.zeros(size + 1)
    at = 0
    for j in range(1, size + 1):
        ahead[j] = ahead[j - 1]
        while at < len(scored) and scored[at][1] == j:
            ahead[j] = np.logaddexp(ahead[j], ahead[scored[at][0]] + scored[at][3])
            at += 1
    starts: dict[int, list] = {}
    for i, j, _, x in scored:
        starts.setdefault(i, []).append((j, x))
    for i in range(size - 1, -1, -1):
        behind[i] = behind[i + 1]
        for j, x in starts.get(i, ()):
            behind[i] = np.logaddexp(behind[i], x + behind[j])
    return float(ahead[size]), np.array([np.exp(ahead[i] + x + behind[j] - ahead[size]) for i, j, _, x in scored])


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """Without punctuation at the edges, but with a parenthesis that opens a number."""
    while e > s and text[e - 1] in _EDGE:
        e -= 1
    closed = text.rfind(")", s, e)
    while s < e and text[s] in _EDGE and not (text[s] == "(" and s < closed):
        s += 1
    return s, e


def _examples(seed: int, count: int):
    """(text, gold segments as (kind, start, end)) from templates."""
    rnd = random.Random(seed)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice(("ta", "ren", "os", "li", "me", "der", "qui", "an", "sto")) for _ in range(rnd.randint(1, 4)))

    def card():
        body = rnd.choice("45") + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban():
        country = rnd.choice(sorted(IBAN_LENGTHS))
        body = d(IBAN_LENGTHS[country] - 4)
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        s = f"{country}{check:02d}{body}"
        return s if rnd.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    octet = lambda: str(rnd.randint(0, 255))
    make = {
        "email": lambda: f"{word()}{rnd.choice('._-')}{d(2)}@{word()}.{rnd.choice(('com', 'org', 'de'))}",
        "ip": lambda: ".".join(octet() for _ in range(4)),
        "card": lambda: (lambda c: rnd.choice((c, "-".join(c[i : i + 4] for i in range(0, 16, 4)), " ".join(c[i : i + 4] for i in range(0, 16, 4)))))(card()),
        "phone": lambda: rnd.choice((f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)} {d(6)}", f"+{d(11)}")),
        "iban": iban,
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "person": lambda: " ".join(rnd.choice((word().title(), word().title(), f"{rnd.choice('ABCDEFGH')}.")) if k else word().title() for k in range(rnd.randint(1, 3))),
        "dob": lambda: rnd.choice((f"{rnd.randint(1, 28):02d}.{rnd.randint(1, 12):02d}.{rnd.randint(1930, 2010)}", f"{rnd.randint(1930, 2010)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}")),
    }
    bare = {"email", "ip", "card", "iban"}  # kinds that need no cue
    junk = (lambda: d(rnd.randint(1, 9)), lambda: f"{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40)), make["dob"], lambda: f"{d(3)}-{d(2)}", lambda: f"{d(2)}%", lambda: f"{d(3)},{d(3)}", lambda: f"{word()}{d(2)}", lambda: f"{d(16)}", lambda: f"{d(2)}:{d(2)}", lambda: d(rnd.randint(7, 15)), lambda: f"{d(4)}-{d(4)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(1)}", lambda: f"{word().title()} {word().title()}", lambda: f"{d(3)}-{d(2)}-{d(4)}")
    for _ in range(count):
        parts, gold = [], []

        def put(s, kind=None, parts=parts, gold=gold):
            at = sum(len(p) + 1 for p in parts)
            if kind:
                gold.append((kind, at, at + len(s)))
            parts.append(s)

        for _ in range(rnd.randint(1, 4)):
            for _ in range(rnd.randint(1, 5)):
                put(word())
            if rnd.random() < 0.6:
                kind = rnd.choice(KINDS)
                if kind == "person":
                    put(rnd.choice(sorted(_TITLES)) + rnd.choice(("", ".")))
                elif kind not in bare or rnd.random() < 0.5:
                    put(rnd.choice(CUES[kind].split()) + rnd.choice(("", ":")))
                    if rnd.random() < 0.3:
                        put(rnd.choice(("is", "number", "on", "at")))
                put(make[kind](), kind)
                if kind == "card" and not luhn("".join(filter(str.isdigit, parts[-1]))):
                    gold.pop()
            else:
                s = rnd.choice(junk)()
                if not (s.isdigit() and len(s) == 16 and luhn(s)):
                    put(s)
        yield " ".join(parts), gold


@functools.cache
def trained(seed: int = SEED, sentences: int = SENTENCES, epochs: int = EPOCHS) -> Model:
    """Weights of the largest conditional likelihood of the template sentences, less a ridge."""
    names: dict[str, int] = {}
    data = []
    for text, gold in _examples(seed, sentences):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        lattice = Lattice(tokens, text)
        starts, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
        want = {(starts[s], ends[e], KINDS.index(k)) for k, s, e in gold}
        known = [[names.setdefault(f, len(names)) for f in found] for *_, found in lattice.segments]
        if known:
            data.append((lattice, known, want))
    w = np.zeros((len(names), len(KINDS)))
    first, second, order, step = np.zeros_like(w), np.zeros_like(w), np.random.default_rng(seed), 0
    for _ in range(epochs):
        places = order.permutation(len(data))
        for at in range(0, len(places), 16):
            slope = RIDGE * w
            for lattice, known, want in (data[p] for p in places[at : at + 16]):
                totals = [w[ids].sum(axis=0) for ids in known]
                scored = [(i, j, k, totals[n][k]) for n, (i, j, kinds, _) in enumerate(lattice.segments) for k in kinds]
                owners = [n for n, (_, _, kinds, _) in enumerate(lattice.segments) for _ in kinds]
                _, p = posteriors(lattice.size, scored)
                for n, (i, j, k, _), chance in zip(owners, scored, p, strict=True):
                    slope[known[n], k] += (chance - ((i, j, k) in want)) / 16
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model({f: w[i] for f, i in names.items()})


def windows(text: str):
    """Runs of tokens around triggers: some before each, and some after a title."""
    run, last = [], -1
    for hit in _TRIGGER.finditer(text):
        if hit.start() < last:
            continue
        s = hit.start()
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        before, at = [], s
        while len(before) < CONTEXT and at > max(last, 0):
            e = at
            while e > 0 and text[e - 1].isspace():
                e -= 1
            b = e
            while b > 0 and not text[b - 1].isspace():
                b -= 1
            if b == e or b < last:
                break
            before.append((b, e))
            at = b
        m = _TOKEN.match(text, s)
        if run and (not before or len(before) < CONTEXT or before[-1][0] <= last):
            run += [t for t in before[::-1] if t[0] >= last]
        else:
            if run:
                yield run
            run = before[::-1]
        run.append(m.span())
        last = m.end()
        for _ in range(3 if m.group().strip(_EDGE) in _TITLES else 0):  # a name follows its title
            m = _TOKEN.search(text, last)
            if m is None:
                break
            run.append(m.span())
            last = m.end()
    if run:
        yield run


def model_spans(text: str, model: Model) -> list[tuple[str, int, int]]:
    out = []
    for tokens in windows(text):
        for i, j, k in model.decode(tokens, text):
            out.append((KINDS[k], *trimmed(text, tokens[i][0], tokens[j - 1][1])))
    return out


def scan(text: str, model: Model) -> list[tuple[str, int, int]]:
    """Base spans and the model's spans apart from them, by kind, then start."""
    base = base_spans(text)
    if not base and not _TRIGGER.search(text):
        return []
    covered = sorted((s, e) for _, s, e in base)
    added, k, reach = [], 0, -1
    for span in model_spans(text, model):
        while k < len(covered) and covered[k][0] < span[2]:
            reach = max(reach, covered[k][1])
            k += 1
        if reach <= span[1]:
            added.append(span)
    return sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, by the
    kind of the first."""
    merged: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    out, at = [], 0
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans) for every row of docs."""
    model = trained()

    def start():
        def step(batch):
            rows = []
            for t in batch.column(1).to_pylist():
                spans = scan(t, model) if t else []
                own = base_spans(t) if spans else []
                counts = Counter(k for k, _, _ in own)
                rows.append((*(counts[k] for k in BASE), _joined(own), _joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            return pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"])

        return step

    return map_batches(_rows(docs), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string", start)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; n_chars, where there is one, counts the new text."""
    model, names = trained(), docs.columns
    at = names.index("text")

    def start():
        def step(batch):
            texts = [redacted(t, scan(t, model)) if t else t for t in batch.column(at).to_pylist()]
            return pa.record_batch([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)], names=names)

        return step

    out = map_batches(docs, docs.schema, start)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
