"""Evaluation: golden comparison (E1) and answer scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.operators import contracts as K
from ledgerguard.plans.bitmap import Bitmap, among, bitmap_of
from ledgerguard.session import written


def golden_diff(actual: DataFrame, expected: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join on the keys; a row per (key, field) whose values differ under NULL-safe
    equality, including rows present on one side only (an empty result expected where golden is none)."""
    a = actual.select(*keys, *[F.col(v).cast("string").alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    e = expected.select(*keys, *[F.col(v).cast("string").alias(f"e_{v}") for v in values], F.lit(True).alias("_e"))
    j = a.join(e, keys, "full_outer")
    per_field = F.array(*[
        F.when(~F.col(f"a_{v}").eqNullSafe(F.col(f"e_{v}")) | F.col("_a").isNull() | F.col("_e").isNull(),
               F.struct(F.lit(v).alias("Field"), F.col(f"e_{v}").alias("Expected"), F.col(f"a_{v}").alias("Actual")))
        for v in values])
    return (j.select(*keys, F.explode(F.filter(per_field, lambda x: x.isNotNull())).alias("d"))
            .select(*keys, "d.Field", "d.Expected", "d.Actual"))


def report_vs_templates(t: dict, as_of=None) -> DataFrame:
    """The portfolio report (expected) against the four core template answers (actual), per contract:
    differences are the documented ones (status literal, currency split) plus any broken rule."""
    c, r, rd = t["contracts"], t["receivables"], t["receivabledetails"]
    rep = K.portfolio_report(t, as_of, ordered=False)
    st = K.contract_status(c)
    nd = K.next_due_total(r, rd)
    inv = (K.invoice_amount(t["leasefinances"], t["leasefundings"], t["payableinvoices"])
           .groupBy("ContractId").agg(F.sum("InvoiceCount").alias("InvoiceCount"),
                                      F.first("InvoiceAmount").alias("InvoiceAmount"),
                                      F.count(F.lit(1)).alias("_cur")))
    os_ = K.outstanding_amount(c, r, rd, as_of)
    actual = (st.join(nd, "ContractId", "left").join(inv, "ContractId", "left").join(os_, "ContractId")
              .select("SequenceNumber", "Status", "NextDueDate", "NextDueTotal",
                      F.coalesce("InvoiceCount", F.lit(0)).alias("InvoiceCount"),
                      F.when(F.col("_cur") == 1, F.col("InvoiceAmount")).alias("InvoiceAmount"), "OutstandingTotal"))
    return golden_diff(actual, rep, ["SequenceNumber"],
                       ["Status", "NextDueDate", "NextDueTotal", "InvoiceCount", "InvoiceAmount", "OutstandingTotal"])


# Acceptance thresholds per question group
THRESHOLDS = {"core": 1.0, "adhoc": 0.8, "pii": 0.75}


def requested_tables(t: dict) -> dict:
    """The tables with the rows that the requests' contracts reach, for answers that concern nothing else: a batch of requests
    meets the large tables where they are read, and what is left of them is written once. Contracts are exactly those asked
    about; the other tables hold a few rows of other contracts too, which no request meets."""
    def hashed(df: DataFrame, column: str) -> Bitmap:
        return bitmap_of(df.select(F.xxhash64(column).alias("key")).distinct(), "key")

    def reached(name: str, column: str, keys: Bitmap) -> DataFrame:
        return written(among(t[name], F.xxhash64(column), keys), f"asked-{name}")

    asked = written(t["requests"].select(F.trim("seq").alias("_seq")).where(F.col("_seq").isNotNull()).distinct(), "asked")
    contracts = among(t["contracts"], F.xxhash64("SequenceNumber"), hashed(asked, "_seq"))
    contracts = written(contracts.join(asked, F.col("SequenceNumber") == F.col("_seq"), "left_semi"), "asked-contracts")
    ids = hashed(contracts, "Id")
    leases, loans = reached("leasefinances", "ContractId", ids), reached("loanfinances", "ContractId", ids)
    receivables = reached("receivables", "EntityId", ids)
    return {"requests": t["requests"], "contracts": contracts, "customers": t["customers"], "leasefinances": leases, "loanfinances": loans,
            "payableinvoices": t["payableinvoices"], "leasefundings": reached("leasefundings", "LeaseFinanceId", hashed(leases, "Id")),
            "receivables": receivables, "receivabledetails": reached("receivabledetails", "ReceivableId", hashed(receivables, "Id"))}


SSN_SHAPE = r"\d{3}-\d{2}-\d{4}"


def eval_cases(t: dict) -> DataFrame:
    """Evaluation cases derived from the requests table: for each request, the outcome and the value its answer must show
    (from the portfolio report, i.e. an independent formulation) and a pattern it must never show (an SSN). A contract that
    does not exist must be told so."""
    rep = K.portfolio_report(t, ordered=False).drop("OutstandingTotal")
    owed = K.outstanding_for_requests(t["requests"], t["contracts"], t["receivables"], t["receivabledetails"])
    c = t["contracts"].select(F.col("SequenceNumber").alias("_seq"), "Status", F.lit(True).alias("_known"))
    req = t["requests"].withColumn("_seq", F.trim("seq"))
    exp = req.join(rep.withColumnRenamed("SequenceNumber", "_seq").drop("Status"), "_seq", "left") \
        .join(c, "_seq", "left").join(owed.select("request_id", "OutstandingTotal"), "request_id", "left")
    status = F.coalesce(F.col("Status"), F.lit(K.NOT_COMMENCED_TEMPLATE))
    required = (F.when(F.col("_known").isNull(), F.array().cast("array<string>"))
                .when(F.col("intent") == "status", F.array(F.concat(F.lit("(?i)"), status)))
                .when(F.col("intent") == "outstanding_amount",
                      F.array(F.regexp_replace(F.col("OutstandingTotal").cast("string"), r"\.", r"\\.")))
                .when((F.col("intent") == "next_due_date") & F.col("NextDueDate").isNotNull(),
                      F.array(F.col("NextDueDate").cast("string")))
                .otherwise(F.array().cast("array<string>")))
    return exp.select("request_id", "seq", F.col("intent").alias("expected_intent"),
                      F.when(F.col("_known").isNull(), "not_found").otherwise("answered").alias("expected_outcome"),
                      F.when(F.col("intent") == "adhoc", "adhoc").otherwise("core").alias("group"),
                      required.alias("required"), F.array(F.lit(SSN_SHAPE)).alias("forbidden"))


def contact_cases(t: dict, contacts: DataFrame, report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The group ``pii``: whoever asks for the contact of a contract must see the customer's e-mail and phone and never an SSN,
    and no e-mail may be in what was sent. ``contacts``: (contract_id, Email, Phone); ``report``: the governed report (R3)."""
    asked = K.resolve_contracts(t["requests"], t["contracts"]).select("request_id", "seq", "ContractId")
    def literal(c: str):
        return F.concat(F.lit(r"\Q"), F.col(c), F.lit(r"\E"))
    cases = asked.join(contacts, F.col("ContractId") == F.col("contract_id")).select(
        "request_id", "seq", F.lit("contact").alias("expected_intent"), F.lit("answered").alias("expected_outcome"), F.lit("pii").alias("group"),
        F.array(literal("Email"), literal("Phone")).alias("required"), F.array(F.lit(SSN_SHAPE)).alias("forbidden"))
    clean = ~F.col("masked_answer").rlike("@")
    answers = asked.join(report, F.col("ContractId") == F.col("contract_id")).select(
        "request_id", F.lit("contact").alias("intent"), F.when(clean, "answered").otherwise("leaked").alias("outcome"), F.col("user_answer").alias("rows_json"))
    return cases, answers


def answer_scoring(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """A case passes when intent and outcome are the expected ones, every required pattern matches the answer with
    commas stripped and no forbidden pattern matches; pass rate per group against its threshold. Cases and answers
    meet on the request and whether it asks for a contact."""
    contact = F.when(F.col("intent") == "contact", True).otherwise(False).alias("_contact")
    j = cases.withColumn("_contact", F.col("expected_intent") == "contact").join(
        answers.select("request_id", contact, "intent", "outcome", "rows_json"), ["request_id", "_contact"], "left")
    text = F.coalesce(F.col("rows_json"), F.lit(""))
    plain = F.regexp_replace(text, ",", "")
    ok = ((F.col("intent") == F.col("expected_intent")) & (F.col("outcome") == F.col("expected_outcome"))
          & F.forall("required", lambda p: F.regexp_like(plain, p))
          & ~F.exists("forbidden", lambda p: F.regexp_like(text, p)))
    thr = F.create_map(*[x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))])
    return (j.withColumn("passed", F.coalesce(ok, F.lit(False)).cast("int")).groupBy("group")
            .agg(F.count(F.lit(1)).alias("cases"), F.sum("passed").alias("passed"))
            .withColumn("pass_rate", F.col("passed") / F.col("cases"))
            .withColumn("threshold", thr[F.col("group")])
            .withColumn("accepted", F.col("pass_rate") >= F.col("threshold")))
