"""Span expressions: PII detection, overlap resolution and text rebuilding as JVM column expressions.

A span is ``struct<start:int, end:int, entity:string, source:string, rank:int>`` with 0-based, end-exclusive
character offsets (Spark's ``length``/``substring`` count code points, as Python does).

Offsets without a UDF, in one regex pass: ``regexp_replace(t, p, MARK + '$0' + MARK)`` wraps every match of
``p`` in a private-use marker; splitting on that single character (no regex) gives gap, match, gap, ...,
and one ``aggregate`` folds the running offset. Texts that already contain the marker use the gap-capturing
form ``(?s)\\G(.*?)(p)`` with two ``regexp_extract_all`` calls. Matches are never empty for these patterns.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerguard.functions import arrow_spans
from ledgerguard.functions import patterns as P
from ledgerguard.session import ship_package
from ledgerguard.sources.policy import DEFAULT, Policy

SPAN = "struct<start:int,end:int,entity:string,source:string,rank:int>"
SPANS = f"array<{SPAN}>"
OFFSETS = "array<struct<start:int,end:int>>"


def _lit_or_col(p) -> Column:
    return p if isinstance(p, Column) else F.lit(p)


def with_gaps(pattern):
    """``(?s)\\G(.*?)(P)``: group 1 is the text since the previous match, group 2 the match. Successive
    matches are exactly the successive ``find()`` matches of ``P`` (look-behinds still see the real text);
    ``\\G`` pins each attempt to the end of the previous match, so once no match is left every further
    start position fails at once and the scan stays linear. Inline flags of ``P`` are hoisted."""
    if isinstance(pattern, Column):
        return F.concat(F.lit("(?s)\\G(.*?)("), pattern, F.lit(")"))
    import re
    lead = re.match(r"\(\?([A-Za-z]+)\)", pattern)
    flags = lead.group(1) if lead else ""
    body = pattern[lead.end():] if lead else pattern
    return F.lit(f"(?s{flags})\\G(.*?)({body})")


# A private-use character that marks match boundaries in the one-pass form (texts containing it take the
# two-pass form instead).
MARK = "\ue000"


def _fold_offsets(pairs: Column, make, out_type: str) -> Column:
    """``pairs`` = array<struct<g:int, m:int>> (gap length, match length) -> folded spans."""
    init = F.struct(F.array().cast(out_type).alias("out"), F.lit(0).alias("pos"))

    def step(acc, x):
        s = acc["pos"] + x["g"]
        return F.struct(F.concat(acc["out"], F.array(make(s, s + x["m"]))).alias("out"), (s + x["m"]).alias("pos"))

    return F.aggregate(pairs, init, step, lambda acc: acc["out"])


def match_offsets(text: Column, pattern, make=None, out_type: str = OFFSETS) -> Column:
    """All non-overlapping matches of ``pattern`` in ``text`` as ``array<struct<start,end>>`` (or whatever
    ``make(start, end)`` builds, typed ``out_type``).

    One regex pass: ``regexp_replace(t, p, MARK + '$0' + MARK)`` wraps every match, and a split on the single
    marker character (no regex) alternates gap, match, gap, ...; an ``aggregate`` folds the running offset.
    Texts that already contain the marker use two ``regexp_extract_all`` calls on the gap-capturing form."""
    t = F.coalesce(text, F.lit(""))
    make = make or (lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    pat = _lit_or_col(pattern)
    pieces = F.split(F.regexp_replace(t, pat, F.lit(MARK + "$0" + MARK)), MARK, -1)
    init = F.struct(F.array().cast(out_type).alias("out"), F.lit(0).alias("pos"), F.lit(0).alias("i"))

    def step(acc, x):                       # pieces alternate gap, match, gap, ...: odd positions are matches
        e = acc["pos"] + F.length(x)
        out = F.when(acc["i"] % 2 == 1, F.concat(acc["out"], F.array(make(acc["pos"], e)))).otherwise(acc["out"])
        return F.struct(out.alias("out"), e.alias("pos"), (acc["i"] + 1).alias("i"))

    one_pass = F.aggregate(pieces, init, step, lambda acc: acc["out"])
    gp = with_gaps(pattern)
    g = F.regexp_extract_all(t, gp, F.lit(1))
    m = F.regexp_extract_all(t, gp, F.lit(2))
    two_pass = _fold_offsets(F.zip_with(g, m, lambda a, b: F.struct(F.length(a).alias("g"), F.length(b).alias("m"))),
                             make, out_type)
    return F.when(t.contains(MARK), two_pass).otherwise(one_pass)


def folded_words(text: Column) -> Column:
    """Maximal runs of word characters (Python's ``\\w``); letters that Java's case-insensitive matching takes for
    equal are written alike."""
    t = F.coalesce(text, F.lit(""))
    other = F.translate(F.lower(F.upper(F.lower(F.translate(t, "İ", "i")))), "ς", "σ")
    return F.when(is_ascii(t), F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9_]+"), F.lit(0))).otherwise(
        F.regexp_extract_all(other, F.lit(f"{P.WORD_CHAR}+"), F.lit(0)))


GRAM = 3  # words of the longest run by which a value is looked up


def grams(words: str) -> Column:
    """64-bit hashes of all runs of 1 to ``GRAM`` words of the array column ``words``. It must be a column, not an
    expression: each run reads it."""
    w, none = F.col(words), F.array().cast("array<bigint>")

    def runs(n: int) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + j) for j in range(n)]))
        return F.when(F.size(w) >= n, hashes).otherwise(none)
    return F.concat(*[runs(n) for n in range(1, GRAM + 1)])


def grams_at(words: str, at: Column) -> Column:
    """The same hashes of the runs that begin at place ``at`` (from 0) of the array, null for runs that pass its end."""
    run = [F.get(F.col(words), at + j) for j in range(GRAM)]
    return F.array(*[F.when(F.size(words) >= at + n, F.xxhash64(F.lit(n), *run[:n])) for n in range(1, GRAM + 1)])


def span_text(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def _span(start, end, entity, source, rank) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), entity.alias("entity"),
                    F.lit(source).alias("source"), F.lit(rank).cast("int").alias("rank"))


def luhn_ok(digits_text: Column) -> Column:
    """Digit checksum of a candidate card (non-digits removed first)."""
    digits = F.regexp_replace(digits_text, r"(?U)\P{Nd}", "")
    return F.call_function("luhn_check", digits)


def _could_match(text: Column, entity: str) -> Column:
    """Necessary condition for a detector to match, far cheaper than the detector: an '@' for emails,
    a decimal digit for the numeric detectors. Texts failing it skip both offset scans."""
    t = F.coalesce(text, F.lit(""))
    if entity == "EMAIL":
        return t.contains("@")
    return t.rlike(r"\p{Nd}")


def regex_spans(text: Column, entity: str) -> Column:
    """Spans of one regex detector (cards must pass the Luhn check)."""
    rank = P.entity_rank(entity, "regex")
    def found(pattern):
        return match_offsets(text, pattern, make=lambda s, e: _span(s, e, F.lit(entity), "regex", rank), out_type=SPANS)
    spans = F.when(is_ascii(F.coalesce(text, F.lit(""))), found(P.ASCII_REGEXES[entity])).otherwise(found(P.REGEXES[entity]))
    if entity == "CREDIT_CARD":
        spans = F.filter(spans, lambda s: luhn_ok(span_text(text, s)))
    return F.when(_could_match(text, entity), spans).otherwise(F.array().cast(SPANS))


def all_regex_spans(text: Column, entities=P.REGEX_ENTITIES) -> Column:
    parts = [regex_spans(text, e) for e in entities]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def known_value_pattern(value: Column) -> Column:
    """Case-insensitive, word-bounded pattern of a known value, ``\\s+`` between its words."""
    said = F.replace(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    quoted = F.concat(F.lit(r"\Q"), F.replace(said, F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E"))
    return F.concat(F.lit(f"(?iU)(?<!{P.WORD_CHAR})"), quoted, F.lit(f"(?!{P.WORD_CHAR})"))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


SPACED = r"[\t-\r]|  "  # white space other than single spaces


def between_spaces(text: Column) -> Column:
    """The lower case of a text between two spaces, so that each of its characters has two neighbours (``holds``)."""
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def holds(text: str, low: str, simple: str, value: Column, plain: Column) -> Column:
    """Whether a text holds a value as whole words, as the value's pattern says. Columns: ``text``, ``low`` (``between_spaces``),
    ``simple`` whether it is ASCII with single spaces; ``plain``: whether the value is ``searchable``. Then its first place
    decides if nothing touches it, or if it is the only one; all else is for the pattern."""
    low, v, word = F.col(low), F.lower(value), F.lit("abcdefghijklmnopqrstuvwxyz0123456789_")
    at = F.instr(low, v)
    whole = ~F.contains(word, F.substring(low, at - 1, F.lit(1))) & ~F.contains(word, F.substring(low, at + F.length(v), F.lit(1)))
    pattern = F.regexp_like(F.col(text), known_value_pattern(value))
    found = F.when(at == 0, F.lit(False)).when(whole, F.lit(True)).when(F.call_function("locate", v, low, at + 1) == 0, F.lit(False)).otherwise(pattern)
    return F.when(F.col(simple) & plain, found).otherwise(pattern)


def simple_text(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return is_ascii(t) & ~t.rlike(SPACED)


def plain_value(value: Column) -> Column:
    """The lower-cased value if plain search can find it in ASCII text as its pattern does, else null: it is ASCII, starts and
    ends with a word character, and no start of it is also an end, so that its occurrences never overlap."""
    v = F.lower(value)
    overlaps = F.exists(F.sequence(F.lit(1), F.greatest(F.length(v) - 1, F.lit(1))),
                        lambda k: (F.length(v) > 1) & (F.left(v, k) == F.right(v, k)))
    return F.when(is_ascii(value) & value.rlike("^[A-Za-z0-9_](?s:.*[A-Za-z0-9_])?$") & ~value.rlike(SPACED) & ~overlaps, v)


def searchable(value: Column) -> Column:
    """Whether a value is found by plain search of ASCII text with single spaces as by its pattern (``arrow_spans``)."""
    return is_ascii(value) & ~value.rlike(SPACED) & (F.trim(value) == value) & (value != "")


def _plain_offsets(low: Column, value: Column) -> Column:
    """Places where the lower-cased ASCII text holds the plain value as whole words. Gaps between its occurrences
    (none overlap) alternate with the value; the characters beside it must be no word characters."""
    gaps = F.split(F.replace(low, value, F.lit(MARK)), MARK, -1)
    n = F.length(value)
    init = F.struct(F.array().cast(OFFSETS).alias("out"), F.lit(0).alias("pos"), F.lit(False).alias("any"), F.lit(False).alias("free"))

    def step(acc, gap):  # ``pos``: where the value before this gap ends; ``free``: nothing touches it on its left
        whole = acc["any"] & acc["free"] & ~gap.rlike("^[a-z0-9_]") & ((gap != "") | (acc["pos"] == F.length(low)))
        out = F.when(whole, F.concat(acc["out"], F.array(F.struct((acc["pos"] - n).alias("start"), acc["pos"].alias("end"))))
                     ).otherwise(acc["out"])
        free = F.when(gap == "", ~acc["any"]).otherwise(~gap.rlike("[a-z0-9_]$"))
        return F.struct(out.alias("out"), (acc["pos"] + F.length(gap) + n).alias("pos"), F.lit(True).alias("any"), free.alias("free"))

    # the last step is that of the gap behind the last occurrence, so ``pos`` runs one value too far: it is dropped
    return F.aggregate(gaps, init, step, lambda acc: acc["out"])


def known_spans(text: Column, known: Column) -> Column:
    """Spans of a row's known values; ``known`` is ``array<struct<value, entity, pattern, plain>>``. Every value
    is matched on its own, so a span always carries the entity of the value that it matched. In ASCII text whose white
    space is single spaces a plain value is searched as it is; all else by the value's pattern."""
    rank = P.entity_rank("PERSON", "known")
    t = F.coalesce(text, F.lit(""))
    simple = simple_text(text)

    def places(low, is_simple):
        def of(v):
            value, at, n = v["plain"], F.instr(low, v["plain"]), F.length(v["plain"])
            word, none = "[a-z0-9_]", F.array().cast(OFFSETS)
            once = F.when(((at == 1) | ~F.substring(low, at - 1, F.lit(1)).rlike(word)) & ~F.substring(low, at + n, F.lit(1)).rlike(word),
                          F.array(F.struct((at - 1).alias("start"), (at - 1 + n).alias("end")))).otherwise(none)
            by_search = (F.when(at == 0, none)
                         .when(F.call_function("locate", value, low, at + 1) == 0, once)  # the common case, done sooner
                         .otherwise(_plain_offsets(low, value)))
            offsets = F.when(is_simple & value.isNotNull(), by_search).otherwise(match_offsets(text, v["pattern"]))
            return F.transform(offsets, lambda o: _span(o["start"], o["end"], v["entity"], "known", rank))
        return F.flatten(F.transform(known, of))
    # the array of one struct binds what all values need, so that it is made once for each text
    bound = F.array(F.struct(F.lower(t).alias("low"), simple.alias("simple")))
    return F.coalesce(F.flatten(F.transform(bound, lambda b: places(b["low"], b["simple"]))), F.array().cast(SPANS))


def trim_possessive(text: Column, spans: Column) -> Column:
    """A span ending in 's or ’s shrinks by two, keeping the possessive outside the token."""
    def f(s):
        t = span_text(text, s)
        poss = t.endswith("'s") | t.endswith("’s")
        return F.struct(s["start"].alias("start"), F.when(poss, s["end"] - 2).otherwise(s["end"]).alias("end"),
                        s["entity"].alias("entity"), s["source"].alias("source"), s["rank"].alias("rank"))
    return F.transform(spans, f)


def token_offsets(text: Column) -> Column:
    return match_offsets(text, P.TOKEN_PATTERN)


def drop_protected(text: Column, spans: Column) -> Column:
    """Spans overlapping an existing ``<TYPE_n>`` token are dropped (idempotent masking)."""
    # one array of all tokens' places, bound once for each text and not found again for each span
    kept = F.flatten(F.transform(F.array(token_offsets(text)), lambda prot: F.filter(
        spans, lambda s: ~F.exists(prot, lambda p: (p["start"] < s["end"]) & (s["start"] < p["end"])))))
    return F.when(F.coalesce(text, F.lit("")).contains("<"), kept).otherwise(spans)


def _skips_regex(policy: Policy) -> bool:
    """Whether no regex-detector match can be allow-listed: every term is free of digits and '@' and every
    allow pattern starts with a letter, while detector matches are digits/separators or contain '@'."""
    return (not any(ch.isdigit() or ch == "@" for t in policy.never_masked for ch in t)
            and all(p[:1].isalpha() for p in policy.never_masked_patterns))


def resolve(text: Column, spans: Column, policy: Policy = DEFAULT) -> Column:
    """Possessive trim, allow-list and token protection, then greedy non-overlap choice ordered by
    (start, longest first, detector rank)."""
    t = F.coalesce(text, F.lit(""))
    trimmed = F.when(t.contains("'s") | t.contains("’s"), trim_possessive(text, spans)).otherwise(spans)
    skips = _skips_regex(policy)

    def keep(s):
        kept = ~policy.allows(span_text(text, s))
        return (s["source"] == "regex") | kept if skips else kept
    cands = drop_protected(text, F.filter(trimmed, keep))
    keyed = F.transform(cands, lambda s: F.struct(s["start"].alias("k1"), (s["start"] - s["end"]).alias("k2"),
                                                  s["rank"].alias("k3"), s.alias("s")))
    ordered = F.transform(F.sort_array(keyed), lambda x: x["s"])
    init = F.struct(F.array().cast(SPANS).alias("out"), F.lit(-1).alias("end"))

    def step(acc, s):
        take = s["start"] >= acc["end"]
        return F.struct(F.when(take, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"),
                        F.when(take, s["end"]).otherwise(acc["end"]).alias("end"))

    chosen = F.aggregate(ordered, init, step, lambda acc: acc["out"])
    return F.when(F.size(spans) > 0, chosen).otherwise(F.array().cast(SPANS))


def portable(policy: Policy) -> bool:
    """Whether ``arrow_spans`` can do a policy's work: patterns of a policy's own are written for Java's engine."""
    return set(policy.never_masked_patterns) <= set(P.ALLOW_PATTERNS) and set(policy.detectors.regex) <= set(P.ASCII_REGEXES)


def spans_by_batch(df: DataFrame, kept: int, known: bool, policy: Policy) -> DataFrame:
    """A row for each span of ``df``'s texts (``arrow_spans``): its first ``kept`` columns, ``_i``, start, end, entity, said,
    value and norm (null for given spans)."""
    ship_package(df.sparkSession)
    fields = df.schema.fields[:kept]
    names = [f.name for f in fields] + ["_i", "start", "end", "entity", "said", "value", "norm"]
    schema = StructType(fields)
    for name in names[kept:]:
        schema = schema.add(name, "integer" if name in ("_i", "start", "end") else "string")
    rules = arrow_spans.Rules(tuple(policy.detectors.regex), frozenset(t.lower() for t in policy.never_masked),
                              tuple(policy.never_masked_patterns), not _skips_regex(policy))
    return df.mapInArrow(arrow_spans.finder(kept, names, known, rules), schema)


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """(pattern of the characters that fold otherwise than to their lower case, JSON map of what they fold to), by
    Unicode's full case folding. The capital sigma is one of them: its lower case depends on what follows it."""
    folds = {chr(i): chr(i).casefold() for i in range(0x110000) if not 0xD800 <= i < 0xE000}
    folds = {c: f for c, f in folds.items() if f != c.lower() or c == "Σ"}
    return "[" + "".join(folds) + "]", json.dumps(folds)


def casefold(c: Column) -> Column:
    """Full case folding: lower case, and letter by letter where a text holds characters that fold otherwise."""
    pattern, folds = _folds()
    table = F.from_json(F.lit(folds), "map<string,string>")
    by_letter = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), F.lower(x))), "")
    return F.when(is_ascii(c), F.lower(c)).when(c.rlike(pattern), by_letter).otherwise(F.lower(c))


def normalize_value(c: Column) -> Column:
    """whitespace collapsed, trimmed, case-folded."""
    return casefold(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def display_value(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def rebuild(text: Column, spans: Column) -> Column:
    """Replace each span (sorted, non-overlapping, with a ``token`` field) by its token: pieces between
    spans are cut with ``substring`` in one ``transform`` (linear), then joined."""
    t = F.coalesce(text, F.lit(""))

    def piece(s, i):
        prev_end = F.when(i == 0, F.lit(0)).otherwise(F.element_at(spans, i)["end"])
        return F.concat(F.substring(t, prev_end + 1, s["start"] - prev_end), s["token"])

    last_end = F.coalesce(F.element_at(spans, -1)["end"], F.lit(0))
    body = F.array_join(F.transform(spans, piece), "")
    tail = F.substring(t, last_end + 1, F.greatest(F.length(t) - last_end, F.lit(0)))
    return F.when(F.size(spans) > 0, F.concat(body, tail)).otherwise(t)


def interleave_replace(text: Column, pattern: str, replacements: Column) -> Column:
    """Rebuild ``text`` with the i-th match of ``pattern`` replaced by ``replacements[i]`` (no offsets needed)."""
    t = F.coalesce(text, F.lit(""))
    pat = with_gaps(pattern)
    g = F.regexp_extract_all(t, pat, F.lit(1))
    m = F.regexp_extract_all(t, pat, F.lit(2))
    consumed = F.aggregate(F.zip_with(g, m, lambda a, b: F.length(a) + F.length(b)), F.lit(0), lambda acc, x: acc + x)
    body = F.array_join(F.zip_with(g, replacements, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.concat(body, F.substring(t, consumed + 1, F.greatest(F.length(t) - consumed, F.lit(0))))
