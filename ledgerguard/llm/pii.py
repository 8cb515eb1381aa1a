"""Personal data: base patterns, and a semi-Markov conditional random field for what they miss.

Base spans are the leftmost non-overlapping matches of four patterns (e-mail, IP, card, phone), each kind on
its own; a match that fails its test (parts above 255, digit counts, Luhn) is dropped and not retried. All
scans are linear in the text, whatever it holds.

A dropped match may still contain data: two cards side by side match as one number of 32 digits. The field
works on zones (runs of digits and the characters used between them, and e-mail addresses written out with
"[at]" or "(dot)"), split into tokens, without tokens of base spans. Candidate segments are runs of at most
``LONGEST`` tokens with a type; features look at the whole segment (digit count, Luhn, grouping, separators,
prefix, neighbours). A dynamic program over the tokens takes the segmentation with the largest score,
choosing boundaries and types together; a token outside all segments scores 0. It costs at most LONGEST
segments for each token and type.

Weights are fitted by maximum likelihood (forward and backward sums over all segmentations) to
``TRAINING_ZONES`` generated zones: entities, lookalikes and neighbours in random order. They depend on the
seed alone, so every table is judged alike.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; repeated rows
give a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
LONGEST = 8
TRAINING_ZONES = 600
EPOCHS = 12
SEED = 7

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# (possessive and anchored at the first digit of a run: the same matches as the plain pattern, in linear time)
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[\[(] ?[aA][tT] ?[\])]")
_DIGITS = re.compile(r"[0-9]+")
_ZONE = re.compile(r"[+(]?[0-9](?:[0-9 ().+-]*[0-9])?")
_AT = re.compile(r" ?[\[(] ?(?:at|AT) ?[\])] ?")
_DOT = re.compile(r" ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_GLUE = frozenset("\"'=._/#$€£@:&\\")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    out = emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(ch.isdigit() for ch in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


# ---- zones, candidates and features ------------------------------------------------------------------

def _neighbours(text: str, start: int, end: int) -> list[str]:
    names = []
    if start and (text[start - 1].isalnum() or text[start - 1] in _GLUE):
        names.append("glued_left")
    if end < len(text) and (text[end].isalnum() or text[end] in _GLUE and not (text[end] in ".:" and not text[end + 1:end + 2].isalnum())):
        names.append("glued_right")
    return names


def _number_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> Iterator[tuple[str, int, int, tuple[str, ...]]]:
    """Types that tokens i..j can be, with span and features."""
    groups = [text[a:b] for a, b in tokens[i:j + 1]]
    between = [text[tokens[x][1]:tokens[x + 1][0]] for x in range(i, j)]
    n = sum(map(len, groups))
    start, end = tokens[i][0], tokens[j][1]
    shape = [len(g) for g in groups]
    if 12 <= n <= 19 and all(s in (" ", "-") for s in between) and luhn("".join(groups)):
        names = ["card", f"card_n{n}", *("card_" + x for x in _neighbours(text, start, end))]
        names.append("card_whole" if len(groups) == 1 else "card_fours" if all(x == 4 for x in shape[:-1]) else
                     "card_465" if shape == [4, 6, 5] else "card_odd")
        if len(set(between)) > 1:
            names.append("card_mixed")
        yield "card", start, end, tuple(names)
    if len(groups) == 4 and between == ["."] * 3 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        yield "ip", start, end, ("ip", *("ip_" + x for x in _neighbours(text, start, end)))
    if 9 <= n <= 15 and len(groups) <= 6 and all(len(s) <= 2 and "+" not in s for s in between):
        plus = start > 0 and text[start - 1] == "+"
        area = start > 0 and text[start - 1] == "("
        start -= plus or area
        names = ["phone", *("phone_" + x for x in _neighbours(text, start, end))]
        if plus:
            names.append("phone_plus")
        if "".join(between).count("(") + area == 1 and "".join(between).count(")") == 1:
            names.append("phone_area")
        if shape[-3:] == [3, 3, 4] and len(shape) <= 4 and len(shape[:-3]) + sum(shape[:-3]) <= 4:
            names.append("phone_334")
        if not between:
            names.append("phone_bare")
        if any(x > 4 for x in shape) and between:
            names.append("phone_long_group")
        yield "phone", start, end, tuple(names)


def _mail_features(text: str, tokens: list[tuple[int, int]], j: int) -> Iterator[tuple[str, int, int, tuple[str, ...]]]:
    """A written-out address: the name and labels 1..j."""
    if j < 2:
        return
    start, end = tokens[0][0], tokens[j][1]
    last = text[tokens[j][0]:end]
    names = ["email", "email_tld" if last.isalpha() and 2 <= len(last) <= 6 else "email_no_tld", *("email_" + x for x in _neighbours(text, start, end))]
    if any(len(text[tokens[x][1]:tokens[x + 1][0]]) > 1 for x in range(1, j)):
        names.append("email_dots_written")
    yield "email", start, end, tuple(names)


Candidate = tuple[int, int, str, int, int, tuple[str, ...]]


def _candidates(text: str, tokens: list[tuple[int, int]], mail: bool) -> list[Candidate]:
    """(first token, last token, kind, start, end, features)."""
    out = []
    for i in range(1 if mail else len(tokens)):
        for j in range(i, min(i + LONGEST, len(tokens))):
            found = _mail_features(text, tokens, j) if mail else _number_features(text, tokens, i, j)
            out.extend((i, j, *c) for c in found)
            if not mail and tokens[j][1] - tokens[i][0] > 40:
                break
    return out


def zones(text: str, taken: list[Span]) -> Iterator[tuple[list[tuple[int, int]], bool]]:
    """(tokens, whether a written-out address) of each stretch of a zone that no base span touches."""
    spans = sorted((a, b) for _, a, b in taken)
    at = 0
    reach = 0  # end of the base spans that start before the token
    for zone in _ZONE.finditer(text):
        if zone.end() - zone.start() < 7:
            continue
        free: list[tuple[int, int]] = []
        for m in _DIGITS.finditer(text, zone.start(), zone.end()):
            while at < len(spans) and spans[at][0] < m.end():
                reach = max(reach, spans[at][1])
                at += 1
            if reach > m.start():
                if free:
                    yield free, False
                free = []
            else:
                free.append((m.start(), m.end()))
        if free:
            yield free, False
    if "[" in text or "(" in text:
        for mark in _AT.finditer(text):
            start = mark.start()
            while start and mark.start() - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            if start == mark.start():
                continue
            tokens = [(start, mark.start())]
            label = _LABEL.match(text, mark.end())
            while label and len(tokens) < LONGEST:
                tokens.append(label.span())
                dot = _DOT.match(text, label.end())
                label = _LABEL.match(text, dot.end()) if dot else None
            if not any(a < tokens[-1][1] and b > start for a, b in spans):
                yield tokens, True


def decode(n: int, candidates: list[Candidate], weights: dict[str, float]) -> list[Span]:
    """The best segmentation of n tokens; of equal ones the one with fewer spans."""
    best: list[float] = [0.0] * (n + 1)
    back: list[Candidate | None] = [None] * (n + 1)
    by_end: dict[int, list[Candidate]] = {}
    for c in candidates:
        by_end.setdefault(c[1], []).append(c)
    for e in range(n):
        best[e + 1] = best[e]
        for c in by_end.get(e, ()):
            score = best[c[0]] + sum(weights.get(name, 0.0) for name in c[5])
            if score > best[e + 1]:
                best[e + 1], back[e + 1] = score, c
    out, e = [], n
    while e:
        c = back[e]
        if c is None:
            e -= 1
        else:
            out.append((c[2], c[3], c[4]))
            e = c[0]
    return out[::-1]


def find(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    added: list[Span] = []
    for tokens, mail in zones(text, base):
        candidates = _candidates(text, tokens, mail)
        if candidates:
            added += decode(len(tokens), candidates, weights)
    return base, sorted(set(base + added), key=lambda s: (s[1], ORDER[s[0]], s[2]))


# ---- training ----------------------------------------------------------------------------------------

def _card(r: random.Random, good: bool = True) -> str:
    n = r.choice((13, 15, 16, 16, 16, 16, 19))
    digits = "".join(r.choice("0123456789") for _ in range(n - 1))
    digits += next(d for d in "0123456789" if luhn(digits + d) == good)
    sep = r.choice(("", "", " ", "-"))
    if n == 15 and sep:
        return sep.join((digits[:4], digits[4:10], digits[10:]))
    return sep.join(digits[i:i + 4] for i in range(0, n, 4)) if sep else digits


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(2, 99)} {a} {b} {c}", f"{a}.{b}.{c}", f"+1{a}{b}{c}"))


def _mail(r: random.Random) -> str:
    word = lambda: "".join(r.choice("abcdefghinorstu") for _ in range(r.randint(3, 8)))
    at, dot = r.choice(((" [at] ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" (AT) ", ".")))
    return word() + at + dot.join([word(), *([word()] if r.random() < 0.3 else []), r.choice(("com", "org", "net", "de"))])


def _junk(r: random.Random) -> str:
    return r.choice((lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}",
                     lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: _digits(r, r.randint(1, 25)),
                     lambda: f"{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}", lambda: ".".join(_digits(r, r.randint(1, 2)) for _ in range(r.choice((2, 3, 5)))),
                     lambda: _card(r, False), lambda: "token=" + _card(r), lambda: "ref/" + _phone(r).strip("+("), lambda: " ".join(_digits(r, r.randint(2, 6)) for _ in range(r.randint(2, 6)))))()


def training_zones(count: int = TRAINING_ZONES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """(text, true spans): one to three items side by side between words."""
    r = random.Random(seed)
    out = []
    for _ in range(count):
        text, spans = r.choice(("call ", "of the ", "with ", "")), []
        for _ in range(r.choice((1, 1, 2, 2, 3))):
            kind = r.choice(("card", "phone", "ip", "email", None, None))
            item = {"card": _card, "phone": _phone, "email": _mail, "ip": lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)), None: _junk}[kind](r)
            if kind:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + r.choice((" ", " ", ", ", "; ", " and "))
        out.append((text + r.choice(("", "or", "x9")), spans))
    return out


def _gradient(n: int, candidates: list[Candidate], gold: set[Span], weights: dict[str, float]) -> dict[str, float]:
    """Gradient of the log likelihood of the gold segmentation, by sums over all segmentations."""
    scores = [math.exp(min(50.0, sum(weights.get(f, 0.0) for f in c[5]))) for c in candidates]
    ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for x, c in enumerate(candidates):
        by_end.setdefault(c[1] + 1, []).append(x)
        by_start.setdefault(c[0], []).append(x)
    for e in range(1, n + 1):
        ahead[e] = ahead[e - 1] + sum(ahead[candidates[x][0]] * scores[x] for x in by_end.get(e, ()))
    for s in range(n - 1, -1, -1):
        behind[s] = behind[s + 1] + sum(scores[x] * behind[candidates[x][1] + 1] for x in by_start.get(s, ()))
    out: dict[str, float] = {}
    for x, c in enumerate(candidates):
        by = (c[2:5] in gold) - ahead[c[0]] * scores[x] * behind[c[1] + 1] / ahead[n]
        for f in c[5]:
            out[f] = out.get(f, 0.0) + by
    return out


@lru_cache(maxsize=4)
def trained(count: int = TRAINING_ZONES, seed: int = SEED) -> tuple[tuple[str, float], ...]:
    """Weights fitted by stochastic gradient steps with a small pull to zero."""
    sample = []
    for text, spans in training_zones(count, seed):
        for tokens, mail in zones(text, []):
            candidates = _candidates(text, tokens, mail)
            if candidates:
                sample.append((len(tokens), candidates, set(spans)))
    weights: dict[str, float] = {}
    for epoch in range(EPOCHS):
        rate = 0.5 / (1 + 0.3 * epoch)
        for n, candidates, gold in sample:
            for f, g in _gradient(n, candidates, gold, weights).items():
                weights[f] = weights.get(f, 0.0) * (1 - 1e-4 * rate) + rate * g
    return tuple(sorted(weights.items()))


# ---- on tables ---------------------------------------------------------------------------------------

def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _finder(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digest, spans = [], []
            for text in batch.column(1):
                base, every = find(text.as_py() or "", weights)
                for kind, column in zip(KINDS, counts):
                    column.append(sum(s[0] == kind for s in base))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                                             ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base counts, base_sha256, spans (kind:start:end of all spans)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, _finder(dict(trained())),
                     "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, weights: dict[str, float]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in find(text, weights)[1]:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _redactor(weights: dict[str, float], place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = pa.array([None if t is None else redact(t, weights) for t in part.column(place).to_pylist()], part.schema.field(place).type)
                yield part.set_column(place, part.schema.field(place), texts)
    return run


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (same columns) with personal data in the texts replaced by its kind."""
    return map_arrow(docs, _redactor(dict(trained()), docs.columns.index(text_col)), docs.schema)
