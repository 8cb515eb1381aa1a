"""JVM span offsets and overlap resolution against brute-force Python."""
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerguard.functions import patterns as P
from ledgerguard.functions import spans as S
from tests.conftest import SF_SMALL

PY = {
    "SSN": re.compile(r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])"),
    "CREDIT_CARD": re.compile(r"(?<![\w-])(?:\d[ -]?){12,15}\d(?![\w-])"),
    "EMAIL": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    "PHONE": re.compile(r"(?<![\w-])(?<!\d\s)(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-])?\d{3}[\s.-]\d{4}(?![\w-])(?!\s\d)"),
}


def test_offsets_equal_python_finditer(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = spark.createDataFrame([(-1, "x 4465758382889437 4465758382889437 y 900-12-3456 (404) 555-0199")],
                                  "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra).select(
        "text", *[S.match_offsets(F.col("text"), P.REGEXES[e]).alias(e) for e in PY]).collect()
    n = 0
    for r in rows:
        for e, rx in PY.items():
            assert [(o.start, o.end) for o in r[e]] == [(m.start(), m.end()) for m in rx.finditer(r.text or "")]
            n += len(r[e])
    assert n > 0


def _greedy(spans):
    chosen = []
    for s in sorted(spans, key=lambda s: (s[0], -(s[1] - s[0]), s[2])):
        if chosen and s[0] < chosen[-1][1]:
            continue
        chosen.append(s)
    return chosen


span = st.tuples(st.integers(0, 40), st.integers(1, 12), st.integers(0, 5)).map(lambda t: (t[0], t[0] + t[1], t[2]))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(span, max_size=8), min_size=1, max_size=6))
def test_resolve_equals_greedy(spark, batches):
    rows = [(i, "z" * 60, [{"start": a, "end": b, "entity": "PERSON", "source": "regex", "rank": k} for a, b, k in sp])
            for i, sp in enumerate(batches)]
    df = spark.createDataFrame(rows, f"id int, text string, spans {S.SPANS}")
    got = {r.id: [(s.start, s.end, s.rank) for s in r.c] for r in
           df.select("id", S.resolve(F.col("text"), F.col("spans")).alias("c")).collect()}
    for i, sp in enumerate(batches):
        assert got[i] == _greedy(sp)
