"""Jaccard components, components of graphs, and repeated passages against brute force."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerguard.llm import graph, jaccard, passages, wordhash
from tests.llm.conftest import SCHEMA, prose


def plain_words(text):
    return (text or "").lower().encode().split()


def plain_set(text, k):
    w = plain_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets = [plain_set(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if sets[i]:
            known = [x for x in (least.get(find(i)), r[0]) if x is not None]
            least[find(i)] = min(known) if known else None
    return [(str(r[0]), len(s), str(least[find(i)] if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets))]


def as_rows(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(docs, rows, k, percent):
    assert as_rows(jaccard.jaccard_components(docs, k, percent)) == sorted(brute_components(rows, k, percent))


def test_heavy_groups_equal_brute_force(spark, monkeypatch):
    """Groups well above the longest light list, copies of copies, and a passage in otherwise new texts."""
    r = random.Random(3)
    monkeypatch.setattr(jaccard, "LIGHT", 3)
    base, passage = prose(r, 120), prose(r, 40)
    texts = []
    for i in range(40):
        copy = list(base)
        for at in r.sample(range(120), r.choice((0, 1, 2, 3, 4, 6))):
            copy[at] = f"n{i}x{r.randrange(4)}"
        texts.append(copy)
        if i % 4 == 0:
            again = list(copy)
            again[r.randrange(120)] = f"m{i}"
            texts.append(again)
    texts += [prose(r, 50) + passage + prose(r, 30) for _ in range(15)] + [prose(r, n, 30) for n in range(1, 14)] * 2
    rows = [(i, " ".join(t), "en", "s", 0) + ("x",) * 9 for i, t in enumerate(texts)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert as_rows(jaccard.jaccard_components(docs, 4, 85)) == sorted(brute_components(rows, 4, 85))


def plain_one_of_each(rows, k, percent):
    """(id, text) of the rows that stay, by brute force over rows."""
    sets = [plain_set(r[1], k) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = [(r[0], r[1]) for r, x in zip(rows, sets) if not x]
    for g in set(group):
        members = [rows[i] for i in range(len(rows)) if group[i] == g and sets[i]]
        if members:
            least = min(members, key=lambda r: (r[0] is None, r[0] or 0))[0]
            out.append((least, {r[1] for r in members if r[0] == least}))
    return out


def check_one_of_each(kept, want):
    """One row for each group, of the least id; among texts of one id any, but the same one however often it stands."""
    got, fixed = [(r.doc_id, r.text) for r in kept.collect()], [w for w in want if not isinstance(w[1], set)]
    for w in fixed:
        got.remove(w)
    for doc_id, texts in (w for w in want if isinstance(w[1], set)):
        (hit,) = {x for x in got if x[0] == doc_id and x[1] in texts}
        got.remove(hit)
    assert got == []


def test_empty_table_and_stage(docs, no_docs, rows):
    assert jaccard.jaccard_components(no_docs, 4, 85).count() == 0
    assert jaccard.one_of_each(no_docs, 5, 80).count() == 0
    kept = jaccard.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    check_one_of_each(kept, plain_one_of_each(rows, 5, 80))


def test_null_and_repeated_ids_lose_no_text_and_no_link(spark):
    r = random.Random(9)
    base, other, third = prose(r, 120), prose(r, 90), prose(r, 90)
    near, far = list(base), list(base)
    for at in (10, 11):
        near[at] = f"n{at}"
    for at in (10, 11, 60, 61, 100):  # linked with ``near`` only
        far[at] = f"n{at}" if at < 60 else f"f{at}"
    near[60] = "f60"
    texts = [(5, base), (None, near), (9, far), (None, other), (None, third), (1, prose(r, 70)), (1, prose(r, 70)), (None, []), (None, []), (None, other)]
    rows = [(i, " ".join(t), "en", "s", 0) + ("x",) * 9 for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, percent in ((4, 85), (5, 80)):
        assert as_rows(jaccard.jaccard_components(df, k, percent)) == sorted(brute_components(rows, k, percent))
    linked = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, 4, 85).collect()}
    assert linked[9] == 5 == linked[5]  # by way of a document without an id
    kept = jaccard.one_of_each(df, 5, 80)
    check_one_of_each(kept, plain_one_of_each(rows, 5, 80))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(["5", "None", "None", "None", "None", "1", "1"])


@given(st.lists(st.text(alphabet=st.sampled_from(list("aAbZ é\t\n\x0b.")), max_size=15), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_words_are_separator_free_runs(texts):
    for row, rows, data, bounds in wordhash.text_runs(pa.array(texts + [None, "x"]).slice(0)):
        hashes, start, end, first = wordhash.words(data, bounds)
        for i in range(rows):
            text = (texts + ["", "x"])[row + i]
            raw = text.encode()
            spans = list(zip((start[first[i]:first[i + 1]] - bounds[i]).tolist(), (end[first[i]:first[i + 1]] - bounds[i]).tolist()))
            assert spans == [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]


def test_graph_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, i) for i in range(200, 260)] + [(7, 7), (1, 2), (1, 2)]
    root: dict = {}
    for a, b in edges:
        x, y = root.setdefault(a, {a}), root.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in y:
                root[n] = x
    want = {n: min(g) for n, g in root.items() if len(g) > 1}
    got = graph.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_chain(x, y):
    """Best chain score over all matches, by the recurrence in n^2 steps."""
    n = len(x)
    order = sorted(range(n), key=lambda i: (x[i], -y[i]))
    score = {}
    for i in order:
        best = max((score[j] - passages.GAP * (x[i] + y[i] - x[j] - y[j] - 2 * passages.K) for j in score if y[j] < y[i] and x[j] < x[i]), default=0)
        score[i] = passages.K + max(0, best)
    return max(score.values())


def chain_score(x, y, run):
    total = passages.K
    for i, j in zip(run[:-1], run[1:]):
        assert x[i] < x[j] and y[i] < y[j]
        total += passages.K - passages.GAP * (x[j] + y[j] - x[i] - y[i] - 2 * passages.K)
    return total


@given(st.lists(st.tuples(st.integers(0, 120), st.integers(0, 120)), min_size=1, max_size=25, unique=True))
@settings(max_examples=150, deadline=None)
def test_chains_are_best(pairs):
    x, y = (np.array(c) for c in zip(*pairs))
    found = passages.chains(x, y)
    assert len({i for run in found for i in run.tolist()}) == sum(map(len, found))
    best = brute_chain(x, y)
    if found and len(found[0]) >= passages.MIN_SEEDS:
        assert max(chain_score(x, y, run.tolist()) for run in found) <= best + 1e-9
    if best > passages.K * 2 + 1e-9 and found:
        assert abs(max(chain_score(x, y, run.tolist()) for run in found) - best) < 1e-9 or best < passages.K * passages.MIN_SEEDS


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
@settings(max_examples=150, deadline=None)
def test_common_words(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if p == q else max(table[i, j + 1], table[i + 1, j])
    assert passages.common_words(np.array(a, np.uint32), np.array(b, np.uint32)) == table[-1, -1]


def test_passages(docs, no_docs, rows):
    """Every run of 60 words that an earlier document holds is covered; clean documents are left alone."""
    texts: dict = {}
    for r in rows:
        if r[0] is not None:
            texts.setdefault(r[0], plain_words(r[1]))
    covered: dict = {}
    for p in passages.repeated_passages(docs).collect():
        assert p.source_doc_id < p.doc_id and p.n_matched >= 0.8 * max(p.end_word - p.start_word, p.source_end - p.source_start)
        assert p.end_word <= len(texts[p.doc_id]) and p.source_end <= len(texts[p.source_doc_id])
        covered.setdefault(p.doc_id, set()).update(range(p.start_word, p.end_word))
    first: dict = {}
    for i in sorted(texts):
        for at in range(len(texts[i]) - 59):
            run = tuple(texts[i][at:at + 60])
            if first.setdefault(run, i) < i:
                assert set(range(at, at + 60)) <= covered[i]
    near = {i for i in range(16, 29)}  # copies, near copies and passage holders of the fixture
    assert set(covered) <= near and {24, 25, 26, 27, 28} & set(covered) == {25, 26, 27, 28}
    assert passages.repeated_passages(no_docs).count() == 0


def covered_words(spark, texts):
    """The words of each document that repeated_passages finds in earlier ones."""
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    out = {i: set() for i in texts}
    for p in passages.repeated_passages(frame).collect():
        assert p.n_matched >= 0.8 * max(p.end_word - p.start_word, p.source_end - p.source_start)
        out[p.doc_id].update(range(p.start_word, p.end_word))
    return out


def test_two_passages_of_one_pair(spark):
    """Both are found, whatever unlike words stand between them in the two documents."""
    r = random.Random(11)
    texts, inside = {}, {}
    gaps = [(n, gap) for n in (60, 100, 200) for gap in (30, 40, 60, 80, 100, 150, 300)]
    for i, (n, gap) in enumerate(gaps):
        first, second = prose(r, n, 10**6), prose(r, n, 10**6)
        for doc in (2 * i, 2 * i + 1):
            texts[doc] = prose(r, 40, 10**6) + first + prose(r, gap, 10**6) + second + prose(r, 40, 10**6)
        inside[2 * i + 1] = {*range(40, 40 + n), *range(40 + n + gap, 40 + 2 * n + gap)}
    found = covered_words(spark, texts)
    assert {i: len(w - found[i]) for i, w in inside.items()} == {i: 0 for i in inside}


def test_mosaic_of_lines(spark):
    """A passage that a document holds whole is found though earlier ones hold each of its lines."""
    r = random.Random(12)
    texts, inside = {}, {}
    for case, sizes in enumerate([(30, 30, 30), (25, 40, 25), (20, 20, 20, 20), (49, 49), (12,) * 8, (30, 30, 30, 30, 30)] * 3):
        at, lines = 100 * case, [prose(r, n, 10**6) for n in sizes]
        for i, line in enumerate(lines):
            texts[at + i] = prose(r, 30, 10**6) + line + prose(r, 30, 10**6)
        block = [w for line in lines for w in line]
        for i in (20, 60):  # others that hold one line stand between the two that hold all
            texts[at + i] = prose(r, 40, 10**6) + block + prose(r, 40, 10**6)
        for i in range(30, 40):
            texts[at + i] = prose(r, 40, 10**6) + lines[i % len(lines)] + prose(r, 40, 10**6)
        inside[at + 60] = set(range(40, 40 + len(block)))
    found = covered_words(spark, texts)
    assert {i: len(w - found[i]) for i, w in inside.items()} == {i: 0 for i in inside}


def test_repeated_line(spark):
    """A passage that repeats one line is found in a second document, also where the line stands alone before it."""
    r = random.Random(13)
    texts, inside = {}, {}
    for case, (n, words, alone) in enumerate([(n, words, alone) for n in (1, 2, 3, 4, 6, 8, 12, 15, 20, 30) for words in (52, 72, 200) for alone in (0, 1)]):
        line = prose(r, n, 10**6)
        block = (line * words)[:words]
        for doc in (2 * case, 2 * case + 1):
            before = line + prose(r, 70, 10**6) if alone and doc % 2 == 0 else []
            texts[doc] = before + prose(r, 40, 10**6) + block + prose(r, 40, 10**6)
        inside[2 * case + 1] = set(range(40, 40 + len(block)))
    found = covered_words(spark, texts)
    assert {i: len(w - found[i]) for i, w in inside.items()} == {i: 0 for i in inside}


def test_repeated_line_with_changes(spark):
    """As above, with every 25th word of the second document's copy changed: nine tenths of all words are found."""
    r = random.Random(14)
    texts, inside = {}, {}
    for case, (n, words) in enumerate([(n, words) for n in (1, 2, 3, 4, 6, 8, 12) for words in (100, 200)] * 2):
        block = (prose(r, n, 10**6) * words)[:words]
        texts[2 * case] = prose(r, 40, 10**6) + block + prose(r, 40, 10**6)
        changed = [f"new{i}" if i % 25 == 24 else w for i, w in enumerate(block)]
        texts[2 * case + 1] = prose(r, 40, 10**6) + changed + prose(r, 40, 10**6)
        inside[2 * case + 1] = set(range(40, 40 + words))
    found = covered_words(spark, texts)
    assert sum(len(w & found[i]) for i, w in inside.items()) >= 0.9 * sum(map(len, inside.values()))


def test_cutting(docs, rows):
    assert passages.cut(b"a b  c\nd e", np.array([0, 2, 5, 7, 9]), np.array([1, 3, 6, 8, 10]), [(1, 3), (2, 4), (9, 12)]) == b"a  e"
    kept = passages.drop_repeats(docs)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert 17 not in texts and texts[15] == rows[15][1] and texts[0] is None and texts[1] == ""
    assert len(plain_words(texts[27])) < len(plain_words(rows[27][1])) - 50
