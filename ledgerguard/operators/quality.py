"""Data-quality checks: the modelling rules of the contract tables, violations as rows.

Every check returns ``(Check, TableName, RowKey, Detail)`` so they can be unioned into one report.
Keys/uniqueness are aggregations, foreign keys and NOT EXISTS are anti joins, value rules are filters;
all run distributed, no row is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.sources.tables import MONEY

# primary/unique keys, enumerations and foreign keys of the contract schema
KEYS = {
    "contracts": [("Id",), ("SequenceNumber",)],
    "customers": [("Id",)],
    "leasefinances": [("Id",), ("ContractId",)],
    "loanfinances": [("Id",), ("ContractId",)],
    "payableinvoices": [("Id",)],
    "leasefundings": [("LeaseFinanceId", "PayableInvoiceId")],
    "receivables": [("Id",)],
}
# Value lists and foreign keys of the contract schema
ENUMS = {
    ("contracts", "Status"): ("Commenced", "PaidOff", "Restructure", "Rebook"),
    ("contracts", "WorkflowStatus"): ("Documents Submitted", "Documents Revision", "Submitted", "Approved", "Commenced"),
    ("contracts", "ContractType"): ("Lease", "Loan"),
    ("customers", "CustomerType"): ("Individual", "Business"),
    ("receivables", "EntityType"): ("CT", "SU"),
    ("receivabledetails", "BillingStatus"): ("Invoiced", "NotInvoiced", "Suppressed", "Suspended", "Paid"),
}
FOREIGN_KEYS = (
    ("leasefinances", "ContractId", "contracts", "Id"),
    ("leasefinances", "CustomerId", "customers", "Id"),
    ("loanfinances", "ContractId", "contracts", "Id"),
    ("loanfinances", "CustomerId", "customers", "Id"),
    ("leasefundings", "LeaseFinanceId", "leasefinances", "Id"),
    ("leasefundings", "PayableInvoiceId", "payableinvoices", "Id"),
    ("receivabledetails", "ReceivableId", "receivables", "Id"),
)
ROW_KEY = {
    "contracts": ("Id",), "customers": ("Id",), "leasefinances": ("Id",), "loanfinances": ("Id",),
    "payableinvoices": ("Id",), "leasefundings": ("LeaseFinanceId", "PayableInvoiceId"),
    "receivables": ("Id",), "receivabledetails": ("ReceivableId", "DueDate"),
}


def _key(cols) -> F.Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def _out(df: DataFrame, check: str, table: str, key: F.Column, detail: F.Column) -> DataFrame:
    return df.select(F.lit(check).alias("Check"), F.lit(table).alias("TableName"),
                     key.alias("RowKey"), detail.alias("Detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dq_keys(t: dict) -> DataFrame:
    """DQ1: NULL keys and duplicate keys (PK and UNIQUE)."""
    parts = []
    for table, keysets in KEYS.items():
        for cols in keysets:
            df = t[table]
            parts.append(_out(df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])),
                              "null_key", table, _key(cols), F.lit(",".join(cols))))
            dup = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            parts.append(_out(dup, "duplicate_key", table, _key(cols),
                              F.concat(F.lit(",".join(cols) + " x"), F.col("n").cast("string"))))
    return _union(parts)


def dq_enums(t: dict) -> DataFrame:
    """DQ2: value outside the allowed set; NULL passes (a CHECK that is not false)."""
    parts = []
    for (table, col), allowed in ENUMS.items():
        bad = t[table].where(~F.col(col).isin(*allowed))
        parts.append(_out(bad, "enum", table, _key(ROW_KEY[table]),
                          F.concat(F.lit(col + "="), F.col(col))))
    return _union(parts)


def dq_foreign_keys(t: dict) -> DataFrame:
    """DQ3: orphans per foreign-key edge (left anti join)."""
    parts = []
    for child, fk, parent, pk in FOREIGN_KEYS:
        orphans = t[child].join(t[parent].select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")
        parts.append(_out(orphans, "foreign_key", child, _key(ROW_KEY[child]),
                          F.concat(F.lit(f"{fk}->{parent}.{pk}="), F.col(fk).cast("string"))))
    return _union(parts)


def dq_balance_range(rd: DataFrame) -> DataFrame:
    """DQ4: 0 <= Balance <= Amount + TaxAmount."""
    bad = rd.where((F.col("Balance") < 0) | (F.col("Balance") > F.col("Amount") + F.col("TaxAmount")))
    return _out(bad, "balance_range", "receivabledetails", _key(ROW_KEY["receivabledetails"]),
                F.concat(F.lit("Balance="), F.col("Balance").cast("string")))


def dq_paid_balance(rd: DataFrame) -> DataFrame:
    """DQ5: a Paid line has zero balance."""
    bad = rd.where((F.col("BillingStatus") == "Paid") & (F.col("Balance") != 0))
    return _out(bad, "paid_balance", "receivabledetails", _key(ROW_KEY["receivabledetails"]),
                F.concat(F.lit("Balance="), F.col("Balance").cast("string")))


def dq_no_details(r: DataFrame, rd: DataFrame) -> DataFrame:
    """DQ6: receivable without any detail (NOT EXISTS)."""
    bad = r.join(rd.select(F.col("ReceivableId").alias("Id")), "Id", "left_anti")
    return _out(bad, "no_details", "receivables", _key(("Id",)), F.lit("no detail rows"))


def dq_rollup_mismatch(r: DataFrame, rd: DataFrame) -> DataFrame:
    """DQ7: parent Amount/TaxAmount differ from the sum of the details."""
    sums = rd.groupBy(F.col("ReceivableId").alias("Id")).agg(
        F.sum("Amount").cast(MONEY).alias("_a"), F.sum("TaxAmount").cast(MONEY).alias("_t"))
    bad = r.join(sums, "Id").where((F.col("Amount") != F.col("_a")) | (F.col("TaxAmount") != F.col("_t")))
    return _out(bad, "rollup_mismatch", "receivables", _key(("Id",)),
                F.concat(F.lit("Amount="), F.col("Amount").cast("string"), F.lit(" details="), F.col("_a").cast("string")))


def dq_finance_type(c: DataFrame, lf: DataFrame, ln: DataFrame) -> DataFrame:
    """DQ8: a lease has a lease finance and no loan finance, and vice versa."""
    has_lf = lf.select(F.col("ContractId").alias("Id")).distinct().withColumn("_lf", F.lit(True))
    has_ln = ln.select(F.col("ContractId").alias("Id")).distinct().withColumn("_ln", F.lit(True))
    j = c.join(has_lf, "Id", "left").join(has_ln, "Id", "left")
    lf_, ln_ = F.col("_lf").isNotNull(), F.col("_ln").isNotNull()
    bad = j.where(((F.col("ContractType") == "Lease") & (~lf_ | ln_)) |
                  ((F.col("ContractType") == "Loan") & (~ln_ | lf_)))
    return _out(bad, "finance_type", "contracts", _key(("Id",)),
                F.concat(F.col("ContractType"), F.lit(" lease="), lf_.cast("string"), F.lit(" loan="), ln_.cast("string")))


def dq_orphan_ct(r: DataFrame, c: DataFrame) -> DataFrame:
    """DQ9: CT receivable pointing to a missing contract."""
    bad = r.where(F.col("EntityType") == "CT").join(c.select(F.col("Id").alias("EntityId")), "EntityId", "left_anti")
    return _out(bad, "orphan_ct", "receivables", _key(("Id",)),
                F.concat(F.lit("EntityId="), F.col("EntityId").cast("string")))


def run_checks(t: dict) -> DataFrame:
    """All checks as one report."""
    return _union([dq_keys(t), dq_enums(t), dq_foreign_keys(t), dq_balance_range(t["receivabledetails"]),
                   dq_paid_balance(t["receivabledetails"]), dq_no_details(t["receivables"], t["receivabledetails"]),
                   dq_rollup_mismatch(t["receivables"], t["receivabledetails"]),
                   dq_finance_type(t["contracts"], t["leasefinances"], t["loanfinances"]),
                   dq_orphan_ct(t["receivables"], t["contracts"])])


def mutated_tables(t: dict) -> dict:
    """A deliberately broken copy of the tables (every row of a class broken, nothing sampled), used to
    prove each check fires: Paid lines keep their amount as balance, inactive parents are off by one cent,
    restructured contracts flip type, SU receivables get an unknown entity type."""
    from ledgerguard.sources.tables import CONTRACT_TABLES
    out = {n: t[n] for n in CONTRACT_TABLES}
    rd = t["receivabledetails"]
    out["receivabledetails"] = rd.withColumn(
        "Balance", F.when(F.col("BillingStatus") == "Paid", F.col("Amount")).otherwise(F.col("Balance")))
    r = t["receivables"]
    out["receivables"] = (r.withColumn("Amount", F.when(~F.col("IsActive"), (F.col("Amount") + F.lit(0.01)).cast(MONEY))
                                       .otherwise(F.col("Amount")))
                          .withColumn("EntityType", F.when(F.col("EntityType") == "SU", F.lit("XX"))
                                      .otherwise(F.col("EntityType"))))
    c = t["contracts"]
    out["contracts"] = c.withColumn("ContractType", F.when(F.col("Status") == "Restructure",
                                                           F.when(F.col("ContractType") == "Lease", "Loan").otherwise("Lease"))
                                    .otherwise(F.col("ContractType")))
    return out


def broken_tables(t: dict) -> dict:
    """A second broken copy, for the checks that sound data keep silent: rebooked contracts lose their number,
    SU receivables come twice, inactive CT receivables and every second lease point nowhere, suspended lines
    owe more than they are worth, suppressed lines are gone."""
    from ledgerguard.sources.tables import CONTRACT_TABLES
    out = {n: t[n] for n in CONTRACT_TABLES}
    c, r, rd, lf = (t[n] for n in ("contracts", "receivables", "receivabledetails", "leasefinances"))
    out["contracts"] = c.withColumn("SequenceNumber", F.when(F.col("Status").eqNullSafe("Rebook"), F.lit(None)).otherwise(F.col("SequenceNumber")))
    away = r.withColumn("EntityId", F.when((F.col("EntityType") == "CT") & ~F.col("IsActive"), -F.col("EntityId")).otherwise(F.col("EntityId")))
    out["receivables"] = away.unionByName(r.where(F.col("EntityType") == "SU"))
    over = (F.col("Amount") + F.col("TaxAmount") + 1).cast(MONEY)
    out["receivabledetails"] = rd.where(F.col("BillingStatus") != "Suppressed").withColumn(
        "Balance", F.when(F.col("BillingStatus") == "Suspended", over).otherwise(F.col("Balance")))
    out["leasefinances"] = lf.withColumn("CustomerId", F.when(F.col("ContractId") % 2 == 0, -F.col("CustomerId")).otherwise(F.col("CustomerId")))
    return out
