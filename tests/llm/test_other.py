"""Quality rules, personal data, nearest neighbours, revisits and the pipeline against brute force."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerguard.llm import knn, pii, quality, revisits
from ledgerguard.llm.common import heavy_light_join

SEPARATED = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    text = text or ""
    words = SEPARATED.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SEPARATED.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, no_docs, rows):
    got = quality.host_rules(docs).collect()
    stats = [(r[0], r[3], *plain_stats(r[1])) for r in rows]
    failed = [s[2] < 20 or 100 * s[6] > 30 * s[2] for s in stats]
    hosts: dict = {}
    for s, f in zip(stats, failed):
        if s[1] is not None:
            n, k = hosts.get(s[1], (0, 0))
            hosts[s[1]] = (n + 1, k + f)
    a, b = quality.beta_prior(sum(n for n, _ in hosts.values()), sum(k for _, k in hosts.values()), len(hosts), sum(k * k / n for n, k in hosts.values()))
    rate = {h: (k + a) / (n + a + b) for h, (n, k) in hosts.items()}
    want = [(str(s[0]), *s[2:], f, not f and rate.get(s[1], 0) <= quality.MAX_HOST_RATE) for s, f in zip(stats, failed)]
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == sorted(want)
    assert quality.host_rules(no_docs).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if w[-1])


def test_bad_host_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 or i % 2 else "x", "good") for i in range(200)] + [(1000 + i, good if i < 5 else "x", "bad") for i in range(60)] + [(2000, "x", "rare"), (2001, good, "rare")]
    verdict = {r.doc_id: r.kept for r in quality.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(v for i, v in verdict.items() if 1000 <= i < 2000)
    assert verdict[2001] and verdict[1] and not verdict[0]


def test_beta_prior_strength():
    even = quality.beta_prior(1000, 100, 10, 10 * 1.0)  # all hosts alike: a strong prior at the mean
    wide = quality.beta_prior(1000, 500, 10, 500.0)  # hosts fail wholly or never: a weak one
    assert math.isclose(even[0] / sum(even), 0.1) and sum(even) > 100 > 1 > sum(wide)
    assert quality.beta_prior(0, 0, 0, 0.0) == (1.0, 1.0)


def test_heavy_light_join(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(600)]
    values = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 300)]], "key string, v int")
    got = heavy_light_join(spark.createDataFrame(rows, "i int, key string"), "key", values, "v").collect()
    table = {"hot": 1, **{f"k{i}": i for i in range(300)}}
    assert sorted((r.i, str(r.v)) for r in got) == sorted((i, str(table.get(k))) for i, k in rows)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15 \
                    or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.ORDER[s[0]], s[2]))


@given(st.text(alphabet=st.sampled_from(list("a1204.@+-() 5é")), max_size=40))
@settings(max_examples=500, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_in_numbers():
    r = random.Random(2)
    for _ in range(300):
        text = " ".join(pii._junk(r) if r.random() < 0.5 else pii._card(r) + r.choice(("", " ", "-", ".")) + pii._phone(r) for _ in range(4))
        assert pii.base_spans(text) == plain_spans(text)


def test_added_spans():
    weights = dict(pii.trained())

    def found(text):
        return [(k, text[a:b]) for k, a, b in pii.find(text, weights)[1]]
    assert found("two 4111111111111111 4111111111111111 cards") == [("card", "4111111111111111")] * 2
    assert found("+1 (578) 555-6437 4111111111111111 x") == [("phone", "+1 (578) 555-6437"), ("card", "4111111111111111")]
    assert found("joe [at] mail.example.com, x") == [("email", "joe [at] mail.example.com")]
    assert found("in 2021 and 1990-2000, CC BY-NC 4.0, version 3.") == []
    assert found("at (a) and [b] 12345678901234567890123") == []
    for long in ("1" * 200_000, "a" * 200_000 + "@", "1." * 20_000, "+1 " * 20_000, "@" * 50_000):
        pii.find(long, weights)


def test_field_on_held_out_zones():
    weights = dict(pii.trained())
    hit = extra = missed = 0
    for text, spans in pii.training_zones(300, seed=99):
        got = set(pii.find(text, weights)[1])
        hit, extra, missed = hit + len(got & set(spans)), extra + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + missed) >= 0.9 and hit / (hit + extra) >= 0.85


def brute_segmentation(n, candidates, weights):
    """Best score over all sets of segments that do not overlap."""
    best = 0.0
    for mask in range(1 << len(candidates)):
        some = [c for i, c in enumerate(candidates) if mask >> i & 1]
        used = [t for c in some for t in range(c[0], c[1] + 1)]
        if len(used) == len(set(used)):
            best = max(best, sum(weights.get(f, 0.0) for c in some for f in c[5]))
    return best


def test_dynamic_program_is_best():
    r, weights = random.Random(8), dict(pii.trained())
    for _ in range(60):
        text = " ".join(r.choice((pii._card, pii._phone, pii._junk))(r) for _ in range(2))
        for tokens, mail in pii.zones(text, []):
            candidates = pii._candidates(text, tokens, mail)
            if 0 < len(candidates) <= 12:
                got = pii.decode(len(tokens), candidates, weights)
                score = sum(max(sum(weights.get(f, 0.0) for f in c[5]) for c in candidates if c[2:5] == s) for s in got)
                assert math.isclose(score, brute_segmentation(len(tokens), candidates, weights), abs_tol=1e-9)


def test_pii_on_a_table(docs, no_docs, rows):
    weights = dict(pii.trained())
    want = []
    for r in rows:
        base = plain_spans(r[1] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        every = set(pii.find(r[1] or "", weights)[1])
        assert every >= set(base)
        want.append((str(r[0]), *[sum(s[0] == k for s in base) for k in pii.KINDS], hashlib.sha256(text.encode()).hexdigest()))
    got = pii.find_personal_data(docs).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert pii.find_personal_data(no_docs).count() == 0
    clean = pii.redact_documents(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0] is None and "joe.doe" not in " ".join(t for t in texts.values() if t) and "[PHONE]" in " ".join(t for t in texts.values() if t)


@pytest.mark.parametrize("block,groups", [(16, 3), (2048, 8)])
def test_neighbours(spark, monkeypatch, block, groups):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "GROUPS", groups)
    r = np.random.default_rng(4)
    good = r.normal(size=(150, 12)).astype(np.float32)
    good[40:60] = good[40]  # ties
    good[70] *= 1e-30
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    rows += [(200, None), (201, [0.0] * 12), (202, [float("nan")] + [1.0] * 11), (203, [None] + [1.0] * 11), (220, []), (None, [1.0] * 12), (204, [float("inf")] * 12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(4)
    got = knn.nearest(vectors, F.col("vec_id") % 20 == 0, k=7).collect()
    want = []
    for q in range(0, 150, 20):
        products = []
        for c in range(150):
            total = 0.0
            for a, b in zip(good[q].tolist(), good[c].tolist()):
                total += a * b
            products.append((-total, c))
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(p for p in products if p[1] != q)[:7])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    few = knn.nearest(vectors.where("vec_id < 3"), F.col("vec_id") == 0, k=7).collect()
    assert sorted((r.rank, r.vec_id) for r in few)[0][0] == 1 and len(few) == 2
    assert knn.nearest(vectors.where("false"), F.lit(True), k=3).count() == 0


def test_neighbours_with_repeated_ids(spark):
    """One id that stands many times, some of its vectors far longer than all others; each query row has its own nearest."""
    r = np.random.default_rng(6)
    vectors = [(0, v) for v in (r.normal(size=(7, 8)) * np.array([1, 3, 3, 3, 3, 3, 3])[:, None]).tolist()]
    vectors += [(i, v) for i, v in enumerate(r.normal(size=(299, 8)).tolist(), 1)] + [(20, r.normal(size=8).tolist()), (33, [9.0] * 8), (33, [9.0] * 8)]
    got = knn.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    want = []
    for q, v in vectors:
        if q % 20 == 0:
            scores = []
            for c, w in vectors:
                total = 0.0
                for a, b in zip(v, w):
                    total += a * b
                scores.append((-total, c))
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(x for x in scores if x[1] != q)[:5])]
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == sorted(want) and len(got) == 5 * (7 + 14 + 1 + 1 - 1)


def test_error_bounds_hold():
    r = np.random.default_rng(1)
    q, c = r.normal(size=(50, 70)) * 10, r.normal(size=(60, 70))
    (q8, qs, qe), (c8, cs, ce) = knn.quantise(q), knn.quantise(c)
    near = knn.tile_products(q8, c8) * qs[:, None] * cs[None, :]
    size = np.sqrt(((c8 * cs[:, None]) ** 2).sum(axis=1))
    bound = np.sqrt((q ** 2).sum(axis=1))[:, None] * ce[None, :] + qe[:, None] * size[None, :]
    assert (np.abs(near - q @ c.T) <= bound + 1e-9).all()


def test_revisits(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        url = r.choice(("http://www.A.com/x/", "https://a.com/x#top", "a.com/x?utm_source=feed", "http://b.com:80/y?a=1&ref=z", None if i % 50 == 0 else "http://b.com/y?a=1"))
        kind, tag = r.choice(("response", "revisit")), r.choice(("t1", "t2", "W/t1", None))
        rows.append((i, url, None if i % 41 == 0 else r.randrange(60), kind, tag, str(r.randrange(2)), f"d{i}", {"date": str(i), "etag": str(tag), "Content-Type": "h"} if i % 3 else None))
    rows.append(rows[5])
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    got = revisits.resolve(spark.createDataFrame(rows, schema).withColumn("slice", F.lit("x"))).collect()
    key = {"http://www.A.com/x/": "a.com/x", "https://a.com/x#top": "a.com/x", "a.com/x?utm_source=feed": "a.com/x",
           "http://b.com:80/y?a=1&ref=z": "b.com/y?a=1", "http://b.com/y?a=1": "b.com/y?a=1", None: None}
    want = []
    for i, url, ts, kind, tag, modified, digest, headers in rows:
        if kind != "revisit":
            continue
        past = [x for x in rows if x[3] == "response" and key[url] is not None and ts is not None and key[x[1]] == key[url] and x[2] is not None and x[2] < ts]
        if not past:
            want.append((i, str(key[url]), "no_response", "None", "None", "None"))
            continue
        last = max(past, key=lambda x: (x[2], x[0]))
        same = tag.removeprefix("W/") == last[4].removeprefix("W/") if tag and last[4] else modified == last[5]
        merged = {k: v for k, v in (last[7] or {}).items() if not (k in ("date", "etag") and headers)} | {k: v for k, v in (headers or {}).items() if k in ("date", "etag")}
        want.append((i, key[url], "resolved" if same else "mismatch", str(last[0]), str(last[6]) if same else "None", str(sorted(merged.items())) if same else "None"))
    assert sorted((r.record_id, str(r.url_key), r.status, str(r.response_id), str(r.digest), str(None if r.headers is None else sorted(r.headers.items()))) for r in got) == sorted(want)
    assert revisits.resolve(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_stages(spark, docs, no_docs, tmp_path):
    for table in (docs.limit(1000), no_docs):
        path = str(tmp_path / ("some" if table is not no_docs else "none"))
        table.write.parquet(f"{path}/documents.parquet")
        before = spark.read.parquet(f"{path}/documents.parquet")
        packed = corpus_pipeline.run(spark, path).collect()
        step = before
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, path)
            assert step.columns == before.columns, name
            step = spark.createDataFrame(step.collect(), before.schema)
        assert sorted({str(r.doc_id) for r in packed}) == sorted(str(r.doc_id) for r in step.collect())
        assert all(r.n_chars == len(r.text) for r in step.collect() if r.text is not None)
