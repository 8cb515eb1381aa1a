"""The model slot of the name detector: held-out accuracy, the same spans as on the driver, on and off by policy, checks of spans."""
import os
import sys
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from ledgerguard.operators import masking as M
from ledgerguard.operators import name_model as N
from ledgerguard.sources.policy import DEFAULT, from_mapping
from train_name_tagger import sentences

POLICY = from_mapping({"detectors": {"ner": {"model": "name_tagger", "entities": ["PERSON", "LOCATION"]}}})


@pytest.fixture(scope="module")
def texts():
    return [None, "", "   ", "퟿🎉 Mara Okafor signed", "x" * 5000] + [t for t, _ in sentences(5, 300, held_out=True)]


def test_held_out_accuracy():
    model, hit, wrong, missed = N.load_model("name_tagger"), 0, 0, 0
    data = sentences(2024, 1500, held_out=True)
    for (_, gold), found in zip(data, model.tag([t for t, _ in data])):
        sure = {s[:3] for s in found if s[3] >= DEFAULT.detectors.name_score}
        hit, wrong, missed = hit + len(sure & set(gold)), wrong + len(sure - set(gold)), missed + len(set(gold) - sure)
    assert hit / (hit + wrong) > 0.93 and hit / (hit + missed) > 0.93


def test_equal_to_a_run_on_the_driver(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(7)
    got = sorted((r.id, r.start, r.end, r.value, r.entity) for r in N.detect_names_model(df, "text", ["id"], POLICY).collect())
    want = []
    for i, (t, spans) in enumerate(zip(texts, N.load_model("name_tagger").tag([t or "" for t in texts]))):
        want += [(i, s, e, t[s:e], {"LOCATION": "ADDRESS"}.get(label, label)) for s, e, label, score in spans if score >= 0.6]
    assert got == sorted(want) and len(got) > 300


def test_policy_picks_the_model(spark, texts, tmp_path):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    everyone = N.detect_names_model(df, "text", ["id"], POLICY).count()
    persons = N.detect_names_model(df, "text", ["id"], from_mapping({"detectors": {"ner": {"model": "name_tagger"}}}))
    assert 0 < persons.count() < everyone and {r[0] for r in persons.select("entity").distinct().collect()} == {"PERSON"}
    path = tmp_path / "other.json"
    path.write_bytes(open(N.model_file("name_tagger"), "rb").read())
    assert N.detect_names_model(df, "text", ["id"], replace(POLICY, detectors=replace(POLICY.detectors, name_model=str(path)))).count() == everyone
    for off in ({"enabled": False, "model": "name_tagger"}, {"model": "en_core_web_sm"}):  # switched off; no such model here
        assert N.detect_names_model(df, "text", ["id"], from_mapping({"detectors": {"ner": off}})).count() == 0


def test_masking_by_the_model(spark):
    df = spark.createDataFrame([(1, "Dear Selma Vossberg, call 555-0100"), (2, "I spoke with Selma Vossberg yesterday")], "id int, text string").withColumn("session_id", F.lit(1))
    m = M.mask_text(N.add_model_spans(df, "text", POLICY), "text", ["id"], extra_spans_col="name_spans", policy=POLICY)
    got = {r.id: r.masked for r in m.cells.collect()}
    assert got == {1: "Dear <PERSON_1>, call <PHONE_1>", 2: "I spoke with <PERSON_1> yesterday"}


@pytest.mark.parametrize("span", [(0, 99, "PERSON", 0.9), (-1, 3, "PERSON", 0.9), (3, 3, "PERSON", 0.9), (0, 3, "PERSON", 1.5), (0, 3, "PERSON", float("nan")), (0, 3, None, 0.9)])
def test_spans_that_do_not_fit_stop_the_job(spark, span):
    df = spark.createDataFrame([("abcdef", [span])], f"t string, s {N.NAME_SPANS}")
    with pytest.raises(Exception, match="name model"):
        df.select(N.checked_spans(F.col("t"), F.col("s"))).collect()


def test_a_model_too_large_is_not_sent(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "LARGEST_MODEL", 10)
    with pytest.raises(ValueError, match="bytes"):
        N.add_model_spans(spark.range(1).select(F.lit("a").alias("t")), "t", POLICY)
