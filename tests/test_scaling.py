"""Steps that grew faster than their input: same results as brute force, and bounded work."""
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerguard import session
from ledgerguard.functions import patterns as P
from ledgerguard.functions import spans as S
from ledgerguard.operators import masking as M
from ledgerguard.operators.vault import session_known
from ledgerguard.plans.ranking import rank_within

def _found(value, text):
    pattern = rf"(?<!\w){r'\s+'.join(map(re.escape, value.split()))}(?!\w)"
    return [(m.start(), m.end()) for m in re.finditer(pattern, text, re.I)]


def test_values_that_share_words_are_no_candidates_of_each_other(spark):
    texts = spark.createDataFrame([(i, f"ssn 900-07-1234, card 4111 1111, call 555-{i:04d} now") for i in range(50)], "id int, text string")
    values = spark.createDataFrame([(f"900-{n:02d}-{w}", "SSN") for n in range(25) for w in ("1234", "4111", "1111")]
                                   + [(f"{w} Market Street", "ADDRESS") for w in ("900", "4111", "555")]
                                   + [("a very long value of many words", "X"), ("555-0007", "PHONE")], "value string, entity string")
    keyed = M.value_keys(values, "value")
    pairs = M.text_keys(texts, "text", ["id"], keyed).join(keyed, "key")
    assert pairs.count() == 51  # by the rarest single word they were some hundreds for each text
    got = {(r.id, r.value) for r in M.leak_scan(texts, "text", ["id"], values).collect()}
    assert got == {(i, "900-07-1234") for i in range(50)} | {(7, "555-0007")}


def test_leak_scan_equals_brute_force(spark):
    texts = ["", "Ann-Marie O'Neil, ann@x.org", "ANN  MARIE o'neil", "annmarie", "x a b a b a y", "Straße STRASSE", "ΟΔΟΣ οδος", "one two three four five",
             "zero one two  three four five six", "one two three five four", "Zoë 555-0555-0555", "Kelvin kelvin", "555-0555 555-05555"]
    values = ["Ann", "Marie", "Ann-Marie", "O'Neil", "a b a", "Straße", "οδος", "one two three four", "two three four five", "555-0555", "Kelvin", "Zoë", "@x.org"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    v = spark.createDataFrame([(x, "X") for x in values], "value string, entity string")
    got = {(r.id, r.value) for r in M.leak_scan(t, "text", ["id"], v, shortest=1).distinct().collect()}
    assert got == {(i, x) for i, text in enumerate(texts) for x in values if _found(x, text)}


def test_leak_scan_by_a_bitmap_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "FEW_VALUES", 0)
    test_leak_scan_equals_brute_force(spark)
    test_values_that_share_words_are_no_candidates_of_each_other(spark)


def test_words_of_texts_are_looked_up_in_compiled_code_and_few_pass_in_vain(spark, monkeypatch):
    """No run of words of a text goes through a lambda (they are interpreted), and the bitmap stops nearly all that are no key."""
    monkeypatch.setattr(M, "FEW_VALUES", 0)
    keyed = M.value_keys(spark.range(60_000).select(F.concat(F.lit("v"), "id").alias("value")), "value")
    texts = spark.range(2000).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), "id") for i in range(10)], F.concat(F.lit("v"), "id")).alias("text"))
    found = M.text_keys(texts, "text", ["id"], keyed)
    assert found.join(keyed, "key").count() == 2000
    assert found.count() - 2000 < 2000  # of 60,000 runs that are no key
    runs = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "xxhash64(1, _words" in line]
    assert runs and "lambda" not in runs[0]


def test_plain_search_equals_the_pattern(spark):
    texts = ["555-0555 555-0555-0555 x555-0555", "ann ann annann ann", "ann\tann ann  lee", "Ann Lee's ann lee", "a b a b a", "ann", "", "_ann ann_", "annann", "ann-ann"]
    values = ["555-0555", "ann", "Ann Lee", "a b a", "b", "ann."]
    kv = spark.createDataFrame([(1, x, "X") for x in values], "session_id int, value string, entity string")
    from dataclasses import replace
    from ledgerguard.sources.policy import DEFAULT
    policy = replace(DEFAULT, detectors=replace(DEFAULT.detectors, shortest_known=1))
    t = spark.createDataFrame([(i, 1, x) for i, x in enumerate(texts)], "id int, session_id int, text string")
    rows = t.join(session_known(kv, policy), "session_id").select("text", S.known_spans(F.col("text"), F.col("known")).alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert sorted((s.start, s.end) for s in r.s) == sorted(p for x in values for p in _found(x, r.text))


def test_ascii_detectors_equal_the_general_ones(spark):
    texts = ["call (404) 555-0199, 1-404-555-0199 or +1 404.555.0199 12 555-0199", "900-12-3456 x900-12-3456 900 12 3456-", "4111 1111 1111 1111 4465758382889437",
             "a@b.co_x@y.com, .@.x.org a@b@c.de", "5 555-0199 555-0199 5", "555\t0199\n555 0199"]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    for e, pattern in P.REGEXES.items():
        for r in t.select(S.match_offsets(F.col("text"), pattern).alias("a"), S.match_offsets(F.col("text"), P.ASCII_REGEXES[e]).alias("b")).collect():
            assert r.a == r.b


def test_large_groups_are_numbered_as_small_ones(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 40).alias("k"), (F.col("id") * 7919 % 3001).alias("o"))
    want = sorted((str(r.k), r.o, r.r) for r in df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("o"))).collect())
    for hot in (10, 100, 10_000):
        assert sorted((str(r.k), r.o, r.r) for r in rank_within(df, ["k"], ["o"], out="r", partitions=5, hot=hot).collect()) == want


def test_tasks_grow_with_the_input_of_a_grouping(spark, tmp_path, monkeypatch):
    spark.range(4000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert session.by_key(df, "id") is df
    monkeypatch.setattr(session, "GROUPING_PART", 512)
    assert session.by_key(df, "id").rdd.getNumPartitions() > 16


def test_mask_rows_shuffles_no_cells(spark):
    """Rows meet their tokens once; cells of equal rows, null and empty cells, and free text beside classified cells."""
    rows = [("Ann", "ann@x.org", "see 911-04-2210", 1), ("Ann", "ann@x.org", "see 911-04-2210", 1), ("", None, None, 2), (None, "b@y.org", "b@y.org and ann@x.org", 2)]
    df = spark.createDataFrame(rows, "Name string, Mail string, Note string, n int").withColumn("session_id", F.lit("s"))
    m = M.mask_rows(df, {"Name": "PERSON", "Mail": "EMAIL"}, ["n"])
    got = sorted((str(r.Name), str(r.Mail), str(r.Note), r.n, sorted(r.pii_counts.items())) for r in m.cells.collect())
    assert got == [("<PERSON_1>", "<EMAIL_1>", "see <SSN_1>", 1, [("EMAIL", 1), ("PERSON", 1), ("SSN", 1)])] * 2 + [
        ("<PERSON_2>", "None", "None", 2, [("PERSON", 1)]), ("None", "<EMAIL_2>", "<EMAIL_2> and <EMAIL_1>", 2, [("EMAIL", 3)])]
    plan = m.cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # spans to tokens, tokens to rows; melted cells meet nothing


def test_a_bitmap_keeps_all_of_its_keys_and_few_others(spark):
    from ledgerguard.plans.bitmap import among, bitmap_of
    keys = spark.range(0, 400_000, 8).select(F.xxhash64("id").alias("key")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS key"))
    bits = bitmap_of(keys, "key", 60_000)
    df = spark.range(400_000).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id"))
    kept = among(df, F.xxhash64("id"), bits)
    assert kept.where("id % 8 = 0").count() == 50_000 and kept.where("id % 8 <> 0").count() < 350_000 // 25
    assert among(df, F.col("id"), bitmap_of(keys.where("key IS NULL"), "key")).count() == 0


def test_answer_scoring_makes_reports_for_the_contracts_asked_about(spark, monkeypatch):
    """Of 1500 contracts 137 are asked about: their reports only are made, with the scores of all contracts' reports."""
    from ledgerguard.operators import evaluate as E
    from ledgerguard.plans import catalog_governance as G
    from tests.conftest import SF_SMALL
    real, made = E.contact_cases, []

    def counted(t, contacts, report):
        made.append((report.count(), contacts.count(), t["contracts"].count()))
        return real(t, contacts, report)

    monkeypatch.setattr(E, "contact_cases", counted)
    got = sorted(map(tuple, G.q_answer_scoring(spark, SF_SMALL).collect()))
    monkeypatch.setattr(E, "requested_tables", lambda t: t)
    assert got == sorted(map(tuple, G.q_answer_scoring(spark, SF_SMALL).collect())) and len(got) == 3
    (reports, contacts, contracts), (all_reports, _, _) = made
    assert contracts == 137 and 137 <= min(reports, contacts) and max(reports, contacts) < 250 and all_reports == 1500


def test_requested_tables_with_null_and_repeated_keys(spark):
    from ledgerguard.operators import evaluate as E
    t = {"requests": spark.createDataFrame([(1, " CT-1 "), (2, "CT-1"), (3, None), (4, "CT-9")], "request_id long, seq string"),
         "contracts": spark.createDataFrame([(1, "CT-1"), (1, "CT-1"), (None, None), (2, "CT-2"), (None, "CT-9")], "Id long, SequenceNumber string"),
         "customers": None, "payableinvoices": None}
    for name, columns, rows in (("leasefinances", "Id long, ContractId long", [(5, 1), (5, 1), (6, 2), (None, 1), (7, None)]),
                                ("loanfinances", "Id long, ContractId long", [(8, 2)]), ("receivables", "Id long, EntityId long", [(10, 1), (None, 1), (11, 2)]),
                                ("leasefundings", "LeaseFinanceId long, PayableInvoiceId long", [(5, 1), (5, 1), (6, 1)]),
                                ("receivabledetails", "ReceivableId long, Balance long", [(10, 3), (10, 3), (11, 4), (None, 5)])):
        t[name] = spark.createDataFrame(rows, columns)
    got = {n: sorted(map(str, map(tuple, df.collect()))) for n, df in E.requested_tables(t).items() if df is not None and n != "requests"}
    assert got["contracts"] == ["(1, 'CT-1')", "(1, 'CT-1')", "(None, 'CT-9')"] and {"(5, 1)", "(None, 1)"} <= set(got["leasefinances"])
    assert got["leasefinances"].count("(5, 1)") == got["leasefundings"].count("(5, 1)") == got["receivabledetails"].count("(10, 3)") == 2
    assert "(6, 2)" not in got["leasefinances"] and got["loanfinances"] == [] and "(10, 1)" in got["receivables"]
