"""Resolved spans of ASCII texts, many texts at a time: what ``spans.detected_spans`` and ``spans.resolve`` give, found in the
Arrow batches of a task.

The texts of a part of a batch are joined by a character that no detector matches and that bounds words as the end of a text
does, so that each detector runs once over all of them. Known values are searched as they are, each in its own text. All
other texts (not ASCII, known values that need their pattern, spans of other detectors) are resolved by Spark's expressions
before and only pass through here (``given``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerguard.functions import patterns as P

BETWEEN = "\0"
PART = 4 << 20  # characters that are joined at once
SPACE = " \t\n\x0b\x0c\r"
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
KNOWN_RANK = P.entity_rank("PERSON", "known")
_W = "A-Za-z0-9_"
# P.ASCII_REGEXES with a first character that Python's engine can skip to
REGEXES = P.ASCII_REGEXES | {
    "SSN": rf"[0-9](?<![{_W}-][0-9])[0-9]{{2}}[- ][0-9]{{2}}[- ][0-9]{{4}}(?![{_W}-])",
    "CREDIT_CARD": rf"[0-9](?<![{_W}-][0-9])[ -]?(?:[0-9][ -]?){{11,14}}[0-9](?![{_W}-])",
}
_TOKEN, _SPACES = re.compile(P.TOKEN_PATTERN, re.ASCII), re.compile(f"[{SPACE}]+")


@dataclass(frozen=True)
class Rules:
    """What of a policy the search needs. ``checked``: whether matches of the detectors can be allow-listed."""
    regexes: tuple[str, ...]
    terms: frozenset[str]
    patterns: tuple[str, ...]
    checked: bool


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def _known(low: str, at: int, end: int, values: list[str], entities: list[str], out: list) -> None:
    """Matches of the values as whole words in the text low[at:end]. As with the value's pattern, the search goes on behind a
    match, and at the next character where a word character touches the value."""
    for value, entity in zip(values, entities):
        i = low.find(value, at, end)
        while i >= 0:
            stop = i + len(value)
            if (i == at or low[i - 1] not in WORD) and (stop == end or low[stop] not in WORD):
                out.append((i, i - stop, KNOWN_RANK, entity))
                i = low.find(value, stop, end)
            else:
                i = low.find(value, i + 1, end)


def spans_of(texts: list[str], known: list[tuple[list[str], list[str]]] | None, rules: Rules) -> tuple[str, np.ndarray, list[tuple[int, int, str]]]:
    """(joined texts, where each starts, chosen spans (start, end, entity) in the joined texts, ascending). ``known``: lower-cased
    values and their entities, for each text."""
    joined = BETWEEN.join(texts)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
    starts = ends - np.array([len(t) for t in texts], np.int64)
    found: list[tuple[int, int, int, str]] = []  # (start, start - end, rank, entity): the order of choice
    for entity in rules.regexes:
        if entity == "EMAIL" and "@" not in joined:
            continue
        rank = P.entity_rank(entity, "regex")
        for m in re.compile(REGEXES[entity], re.ASCII).finditer(joined):
            if entity != "CREDIT_CARD" or luhn(m.group()):
                s, e = m.span()
                found.append((s, s - e, rank, entity))
    if known is not None:
        low = joined.lower()
        for at, end, (values, entities) in zip(starts.tolist(), ends.tolist(), known):
            _known(low, at, end, values, entities, found)
    if "'s" in joined:
        found = [(s, n + 2 if joined.endswith("'s", s, s - n) else n, r, x) for s, n, r, x in found]
    patterns = re.compile("|".join(f"(?:{p})" for p in rules.patterns) or r"(?!)", re.ASCII)

    def allowed(fragment: str) -> bool:
        bare = fragment.strip(SPACE)
        return bare.lower() in rules.terms or patterns.fullmatch(bare) is not None

    found = [x for x in found if (x[2] < KNOWN_RANK and not rules.checked) or not allowed(joined[x[0]:x[0] - x[1]])]
    if "<" in joined:
        tokens = np.array([m.span() for m in _TOKEN.finditer(joined)], np.int64).reshape(-1, 2)
        if len(tokens) and found:
            first = np.searchsorted(tokens[:, 1], [x[0] for x in found], "right")  # the first token that ends behind the start
            begins = np.append(tokens[:, 0], len(joined) + 1)[first]
            found = [x for x, b in zip(found, begins.tolist()) if b >= x[0] - x[1]]
    found.sort()
    chosen, last = [], -1
    for s, n, _, entity in found:
        if s >= last:
            last = s - n
            chosen.append((s, last, entity))
    return joined, starts, chosen


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > PART:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def _found(batch: pa.RecordBatch, kept: int, names: list[str], known: bool, rules: Rules) -> Iterator[pa.RecordBatch]:
    text, given = batch.column(kept), batch.column(batch.num_columns - 1)
    own = pa.RecordBatch.from_arrays([batch.column(i) for i in range(kept)], batch.schema.names[:kept])

    def rows(at: np.ndarray, *cols: pa.Array) -> pa.RecordBatch:
        # the number of a span among those of its row: rows ascend
        order = np.arange(len(at)) - np.searchsorted(at, at, "left")
        return pa.RecordBatch.from_arrays([*own.take(pa.array(at)).columns, pa.array(order.astype(np.int32)), *cols], names)

    passed = given.drop_null().flatten() if given.null_count < len(given) else []
    if len(passed):
        sizes = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False)
        none = pa.nulls(len(passed), pa.string())
        yield rows(np.repeat(np.arange(len(given)), sizes), *[passed.field(c) for c in ("start", "end", "entity", "said")], none, none)
    easy = np.flatnonzero(given.is_null().to_numpy(zero_copy_only=False))
    if not len(easy):
        return
    texts = [t or "" for t in text.take(pa.array(easy)).to_pylist()]
    values = None
    if known:
        lists = batch.column(kept + 1).take(pa.array(easy))
        flat = lists.flatten()
        plain, entities = pc.utf8_lower(flat.field("value")).to_pylist(), flat.field("entity").to_pylist()
        cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).tolist()
        values = [(plain[a:b], entities[a:b]) for a, b in zip(cuts, cuts[1:])]
    for a, b in _parts([len(t) for t in texts]):
        joined, starts, chosen = spans_of(texts[a:b], values[a:b] if values is not None else None, rules)
        if not chosen:
            continue
        s, e = np.array([x[0] for x in chosen]), np.array([x[1] for x in chosen])
        of = np.searchsorted(starts, s, "right") - 1
        said = [joined[x[0]:x[1]] for x in chosen]
        value = [_SPACES.sub(" ", t).strip(" ") for t in said]
        yield rows(easy[a:b][of], pa.array((s - starts[of]).astype(np.int32)), pa.array((e - starts[of]).astype(np.int32)), pa.array([x[2] for x in chosen], pa.string()),
                   pa.array(said, pa.string()), pa.array(value, pa.string()), pa.array([v.lower() for v in value], pa.string()))


def _run(batches: Iterator[pa.RecordBatch], kept: int, names: list[str], known: bool, rules: Rules) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _found(batch, kept, names, known, rules)


def finder(kept: int, names: list[str], known: bool, rules: Rules):
    """For ``mapInArrow``: columns to keep, text, known values (if ``known``) and given spans -> a row for each span."""
    return partial(_run, kept=kept, names=names, known=known, rules=rules)
