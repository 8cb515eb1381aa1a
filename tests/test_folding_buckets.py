"""Case folding, bucketed tables, the outgoing scan's word filter and runs of ad-hoc queries."""
import random
import re

from pyspark.sql import functions as F

from ledgerguard.functions import spans as S
from ledgerguard.operators import adhoc as AD
from ledgerguard.operators import contracts as K
from ledgerguard.operators import masking as M
from ledgerguard.sources import tables as T
from tests.conftest import SF_SMALL


def test_case_folding_is_pythons(spark):
    r = random.Random(3)
    odd = ["Straße", "STRASSE", "İstanbul", "ΟΔΟΣ", "ὈΔΥΣΣΕΎΣ", "ſtop", "K", "ﬁn", "ŉ", "ǅ", "Ꭰ", "ꭰ", "ẞ", "Σ", "ς", "µ", "ΐ", "", "plain TEXT", "日本", "É"]
    odd += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x370, 0x530), r.randrange(0x1E00, 0x2000)])) for _ in range(8)) for _ in range(500)]
    got = {x.t: x.f for x in spark.createDataFrame([(t,) for t in odd + [None]], "t string").select("t", S.casefold(F.col("t")).alias("f")).collect()}
    assert got.pop(None) is None and {t: f for t, f in got.items() if f != t.casefold()} == {}


def test_one_person_under_two_spellings_is_one_token(spark):
    df = spark.createDataFrame([(1, 1, "a@b.io A@B.IO")], "id int, session_id int, text string")
    known = spark.createDataFrame([(1, "x", "Jana Weiß", "PERSON")], "session_id int, norm string, value string, entity string")
    two = spark.createDataFrame([(1, 1, "JANA WEIß and jana weiß")], "id int, session_id int, text string")
    assert M.mask_text(df, "text", ["id"]).cells.first().masked == "<EMAIL_1> <EMAIL_1>"
    assert M.mask_text(two, "text", ["id"], known_values=known).cells.first().masked == "<PERSON_1> and <PERSON_1>"


def test_the_report_over_bucketed_tables_needs_no_exchange_for_its_join(spark):
    plain = T.contract_tables(spark, SF_SMALL)
    T.save_bucketed({n: plain[n] for n in T.CONTRACT_TABLES}, "ledger_test", 4)
    saved = T.bucketed_tables(spark, "ledger_test")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = K.receivable_details(saved["receivables"], saved["receivabledetails"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and len(re.findall(r"Bucketed: true", plan)) == 2
        got, want = (sorted(map(str, K.portfolio_report(t, ordered=False).collect())) for t in (saved, plain))
        assert got == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql("DROP DATABASE ledger_test CASCADE")


def test_leak_scan_with_and_without_the_word_filter(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "call Ada Lovelace"), (2, "nothing"), (3, "ada lovelace, 12 Mill Road and ADA"), (4, None)], "id int, t string")
    values = spark.createDataFrame([("Ada Lovelace", "PERSON"), ("Ada", "PERSON"), ("12 Mill Road", "ADDRESS"), ("Bo", "PERSON"), (None, "ZIP")], "value string, entity string")
    want = [(1, "Ada"), (1, "Ada Lovelace"), (3, "12 Mill Road"), (3, "Ada"), (3, "Ada Lovelace")]
    for few in (M.FEW_VALUES, 0):
        monkeypatch.setattr(M, "FEW_VALUES", few)
        assert sorted((r.id, r.value) for r in M.leak_scan(texts, "t", ["id"], values).collect()) == want


def test_runs_are_recorded_as_they_were(spark, seed, tmp_path):
    queries = {"mails": ("SELECT contract_id, Email, 'x@y.io' AS note FROM customers WHERE Email <> 'someone@else.io'", {}),
               "numbers": ("SELECT count(*) AS n FROM contracts", {}), "no": ("SELECT SSN FROM customers", {})}
    tables = {n: seed[n] for n in T.CONTRACT_TABLES}
    runs = {r.query: r for r in AD.run_governed(tables, queries, str(tmp_path)).collect()}
    rows = spark.read.parquet(str(tmp_path / "mails")).collect()
    assert runs["mails"].row_count == len(rows) > 0 and runs["mails"].pii_columns == {"Email": "EMAIL"}
    assert runs["mails"].pii_masked_output == {"EMAIL": sum(r.Email is not None for r in rows) + len(rows)}
    assert "someone@else.io" not in runs["mails"].sql and runs["mails"].sql.startswith("SELECT contract_id") and all(r.latency_ms >= 0 for r in runs.values())
    assert (runs["numbers"].row_count, runs["numbers"].pii_masked_output) == (1, {})
    assert (runs["no"].outcome, runs["no"].sql_errors, runs["no"].row_count) == (AD.REFUSED, [AD.NOT_RESOLVED], 0)
