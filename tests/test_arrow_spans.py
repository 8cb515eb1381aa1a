"""Spans found by batch equal those of Spark's expressions; known values and their sessions are dealt and asked for sparingly."""
import random
from dataclasses import replace

from pyspark.sql import functions as F

from ledgerguard.functions import arrow_spans
from ledgerguard.operators import audit as A
from ledgerguard.operators import masking as M
from ledgerguard.operators import vault as V
from ledgerguard.sources.policy import DEFAULT

# an allow pattern of its own, which matches nothing here, keeps a policy's texts with Spark's expressions
PLAIN = replace(DEFAULT, never_masked_patterns=(*DEFAULT.never_masked_patterns, "no such text"))
PIECES = ["555-0148", "1 555-0148", "+1 (404) 555-0199", "404.555.0199", "900-12-3456", "900 12 3456", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004",
          "a.b@x.org", "_x@c.de", "Wanda", "RUIZ's", "wanda ruiz", "wandaruiz", "8 Tannery Row", "8  Tannery\tRow", "<PERSON_1>", "<EMAIL_12>", "CT-1001", "Paid", "\n", "\r\n",
          "\0", "\x1c", "22022", "2202202", "5-5", "'s", "-", "_", "(", ".", " ", "  ", "é", "ſ", "’s", "９００-12-3456", "x", "1", "lease ", "zoë"]
VALUES = [("Wanda", "PERSON"), ("Ruiz", "PERSON"), ("Wanda Ruiz", "PERSON"), ("8 Tannery Row", "ADDRESS"), ("22022", "ZIP"), ("555-0148", "PHONE"), ("a.b@x.org", "EMAIL"),
          ("Paid", "PERSON"), ("CT-1001", "PERSON"), ("x's", "PERSON"), ("5-5", "ZIP"), ("Wanda", "ADDRESS"), ("(x)", "ADDRESS")]


def _texts(n):
    rng = random.Random(5)
    return [None, "", " "] + ["".join(rng.choice(PIECES) + rng.choice(["", "", " ", ", "]) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def _occurrences(spark, policy, rows, kv=None, extra=None):
    df = spark.createDataFrame(rows, "id int, session_id string, text string").withColumn("_rid", M.row_id(F.col("id")))
    if extra is not None:
        df = df.withColumn("more", extra)
    occ = M._occurrences(df, ["id"], "text", None, None, "session_id", kv, "more" if extra is not None else None, policy)
    return sorted((r._at.o0, r._i, r.start, r.end, r.entity, r.value, r.norm, r.session_id or "") for r in occ.collect())


def test_batches_find_what_the_expressions_find(spark):
    rows = [(i, "s" if i % 3 else None, t) for i, t in enumerate(_texts(3000))]
    kv = spark.createDataFrame([("s", v.lower(), v, e) for v, e in VALUES], "session_id string, norm string, value string, entity string")
    for known in (None, kv, kv.unionByName(spark.createDataFrame([("s", "zoë", "Zoë", "PERSON")], kv.schema))):
        for rules in (DEFAULT, replace(DEFAULT, never_masked=("555-0148",)), replace(DEFAULT, detectors=replace(DEFAULT.detectors, regex=("EMAIL",)))):
            plain = replace(rules, never_masked_patterns=PLAIN.never_masked_patterns)
            got = _occurrences(spark, rules, rows, known)
            assert got == _occurrences(spark, plain, rows, known) and len(got) > 500


def test_spans_of_other_detectors_stay_with_the_expressions(spark):
    rows = [(i, "s", f"Wanda wrote to a{i}@x.org") for i in range(20)]
    extra = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("PERSON").alias("entity"),
                                                            F.lit("ner").alias("source"), F.lit(200).alias("rank"))))
    got = _occurrences(spark, DEFAULT, rows, extra=extra)
    assert got == _occurrences(spark, PLAIN, rows, extra=extra) and sum(r[4] == "PERSON" for r in got) == 10


def test_a_batch_is_searched_in_parts(monkeypatch):
    monkeypatch.setattr(arrow_spans, "PART", 10)
    assert list(arrow_spans._parts([4, 5, 2, 30, 1, 0])) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(arrow_spans._parts([])) == []


def test_known_values_are_found_in_ascii_texts_without_patterns(spark):
    """Patterns were made and shuffled for each value of each session."""
    kv = spark.createDataFrame([("s", v.lower(), v, e) for v, e in VALUES], "session_id string, norm string, value string, entity string")
    assert "pattern" not in V.session_values(kv).schema.simpleString()
    assert V.session_values(kv).select("searchable").first()[0]


def test_profiles_are_dealt_by_their_size(spark, monkeypatch, tmp_path):
    """One task read, spread and sorted all values of a small file of profiles."""
    rows = spark.range(2000).select(*[F.concat(F.lit(c), (F.col("id") % 1500).cast("string")).alias(c) for c in
                                      ("FirstName", "LastName", "AddressLine1", "AddressLine2", "Zip", "Phone", "Email")], (F.col("id") % 1500).alias("session_id"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/profiles")
    rows = spark.read.parquet(f"{tmp_path}/profiles")
    small = sorted(map(str, V.register_known(rows).collect()))
    monkeypatch.setattr(V, "PROFILE_PART", 1 << 10)
    dealt = V.register_known(rows)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan  # no task groups before values are dealt
    assert sorted(map(str, dealt.collect())) == small and len(small) == 1500 * 8


def test_only_notes_that_turns_ask_for_are_joined(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "c"), (9, 0, "user", None)],
                                  "conv_id long, turn long, role string, text string")
    notes = spark.createDataFrame([(1, "n1"), (2, "n2"), (2, "again"), (9, "n9"), (None, "none")], "ContractId long, note string")
    out = A.with_notes(turns, notes)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [
        (1, 0, "user", "a | n1"), (1, 1, "assistant", "b"), (None, 0, "user", "c"), (9, 0, "user", "n9")]))
