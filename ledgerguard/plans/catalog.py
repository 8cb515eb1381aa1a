"""Registry of named queries: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the driver tables. Oracle SQL
is written against the driver tables with the contract views of ``oracle_views`` as CTEs; computed
columns carry the same aliases on both sides. Queries without a SQL form are registered with ``None``
and have their own brute-force unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerguard.operators import contracts as K
from ledgerguard.operators import quality as Q
from ledgerguard.plans.oracle_views import with_views
from ledgerguard.sources.tables import contract_tables, table_counts, build_receivables, CONTRACT_TABLES

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}

AS_OF_SQL = "DATE '1998-10-01'"


def query(name: str, sql: str | None):
    def deco(fn: Callable):
        REGISTRY[name] = (fn, with_views(sql) if sql else None)
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str):
    return contract_tables(spark, sf_dir)


# --- S: sources -----------------------------------------------------------------------
@query("src_table_counts", "\nUNION ALL ".join(
    f"SELECT '{n}' AS TableName, COUNT(*) AS Rows FROM {n}" for n in CONTRACT_TABLES))
def q_src_table_counts(spark, d):
    return table_counts(T(spark, d))


@query("src_receivable_rollup", """
SELECT r.Id, r.EntityId, r.EntityType, CAST(SUM(d.Amount) AS DECIMAL(18,2)) AS Amount,
  CAST(SUM(d.TaxAmount) AS DECIMAL(18,2)) AS TaxAmount, r.DueDate, r.IsActive
FROM receivables r JOIN receivabledetails d ON d.ReceivableId = r.Id
GROUP BY r.Id, r.EntityId, r.EntityType, r.DueDate, r.IsActive""")
def q_src_receivable_rollup(spark, d):
    t = T(spark, d)
    staged = t["receivables"].drop("Amount", "TaxAmount")
    return build_receivables(staged, t["receivabledetails"])


# --- P: projections / filters ---------------------------------------------------------
@query("contract_status", """
SELECT Id AS ContractId, SequenceNumber, COALESCE(Status, 'Not yet commenced') AS Status, WorkflowStatus
FROM contracts""")
def q_contract_status(spark, d):
    return K.contract_status(T(spark, d)["contracts"])


@query("active_receivables", "SELECT * FROM receivables WHERE EntityType = 'CT' AND IsActive")
def q_active_receivables(spark, d):
    return K.active_receivables(T(spark, d)["receivables"])


@query("unbilled_details", "SELECT * FROM receivabledetails WHERE BillingStatus = 'NotInvoiced' AND NOT IsTaxAssessed")
def q_unbilled_details(spark, d):
    return K.unbilled_details(T(spark, d)["receivabledetails"])


@query("due_as_of", f"SELECT * FROM receivables WHERE DueDate <= {AS_OF_SQL}")
def q_due_as_of(spark, d):
    return K.due_as_of(T(spark, d)["receivables"])


@query("open_balance", """
SELECT * FROM receivabledetails WHERE BillingStatus NOT IN ('Paid', 'Suppressed', 'Suspended') AND Balance > 0""")
def q_open_balance(spark, d):
    return K.open_balance(T(spark, d)["receivabledetails"])


_SCHEDULE_SQL = """
SELECT r.EntityId AS ContractId, rd.DueDate, CAST(SUM(rd.Amount) AS DECIMAL(18,2)) AS Amount,
  CAST(SUM(rd.TaxAmount) AS DECIMAL(18,2)) AS TaxAmount
FROM receivables r JOIN receivabledetails rd ON rd.ReceivableId = r.Id
WHERE r.EntityType = 'CT' AND r.IsActive AND rd.BillingStatus = 'NotInvoiced' AND NOT rd.IsTaxAssessed
GROUP BY r.EntityId, rd.DueDate"""

_NEXT_DUE_SQL = f"""
SELECT ContractId, DueDate AS NextDueDate, Amount, TaxAmount FROM ({_SCHEDULE_SQL}) s
QUALIFY row_number() OVER (PARTITION BY ContractId ORDER BY DueDate) = 1"""


@query("next_due_total", f"""
SELECT ContractId, NextDueDate, CAST(Amount + TaxAmount AS DECIMAL(18,2)) AS NextDueTotal FROM ({_NEXT_DUE_SQL}) n""")
def q_next_due_total(spark, d):
    t = T(spark, d)
    return K.next_due_total(t["receivables"], t["receivabledetails"])


@query("contract_facts", """
SELECT c.Id AS ContractId, c.SequenceNumber, c.CommencementDate, c.ContractType, c.WorkflowStatus,
  COALESCE(lf.BookingDate, ln.BookingDate) AS BookingDate, lf.DownPayment, cu.CustomerType
FROM contracts c LEFT JOIN leasefinances lf ON lf.ContractId = c.Id LEFT JOIN loanfinances ln ON ln.ContractId = c.Id
LEFT JOIN customers cu ON cu.Id = COALESCE(lf.CustomerId, ln.CustomerId)""")
def q_contract_facts(spark, d):
    t = T(spark, d)
    return K.contract_facts(t["contracts"], t["leasefinances"], t["loanfinances"], t["customers"])


@query("param_batch", """
SELECT q.request_id, c.Id AS ContractId, CAST(COALESCE((
    SELECT SUM(rd.Balance) FROM receivables r JOIN receivabledetails rd ON rd.ReceivableId = r.Id
    WHERE r.EntityType = 'CT' AND r.EntityId = c.Id AND r.IsActive AND r.DueDate <= q.as_of
      AND rd.BillingStatus NOT IN ('Paid', 'Suppressed', 'Suspended') AND rd.Balance > 0), 0) AS DECIMAL(18,2))
  AS OutstandingTotal
FROM requests q JOIN contracts c ON c.SequenceNumber = trim(q.seq)""")
def q_param_batch(spark, d):
    t = T(spark, d)
    return K.outstanding_for_requests(t["requests"], t["contracts"], t["receivables"], t["receivabledetails"])


@query("restricted_projection", """
SELECT Id, FirstName, LastName, CustomerType, AddressLine1, AddressLine2, Zip, Phone, Email FROM customers""")
def q_restricted_projection(spark, d):
    from ledgerguard.operators.scope import drop_restricted
    return drop_restricted(T(spark, d)["customers"], "customers")


# --- J: joins -------------------------------------------------------------------------
@query("resolve_contract", """
SELECT q.request_id, q.seq, q.intent, q.as_of, c.Id AS ContractId, c.ContractType
FROM requests q JOIN contracts c ON c.SequenceNumber = trim(q.seq)""")
def q_resolve_contract(spark, d):
    t = T(spark, d)
    return K.resolve_contracts(t["requests"], t["contracts"])


@query("contract_not_found", """
SELECT q.* FROM requests q WHERE NOT EXISTS (SELECT 1 FROM contracts c WHERE c.SequenceNumber = trim(q.seq))""")
def q_contract_not_found(spark, d):
    t = T(spark, d)
    return K.unknown_contracts(t["requests"], t["contracts"])


@query("receivable_detail_join", """
SELECT rd.ReceivableId, r.EntityId AS ContractId, r.DueDate AS ReceivableDueDate, rd.IsTaxAssessed, rd.BillingStatus,
  rd.DueDate, rd.Amount, rd.TaxAmount, rd.Balance
FROM receivables r JOIN receivabledetails rd ON rd.ReceivableId = r.Id WHERE r.EntityType = 'CT' AND r.IsActive""")
def q_receivable_detail_join(spark, d):
    t = T(spark, d)
    return K.receivable_details(t["receivables"], t["receivabledetails"])


@query("lease_invoices", """
SELECT lf.ContractId, pi.Id AS PayableInvoiceId, pi.InvoiceAmount, pi.InvoiceTaxAmount, pi.Currency, pi.InvoiceDate,
  pi.Status AS InvoiceStatus
FROM leasefinances lf JOIN leasefundings lfu ON lfu.LeaseFinanceId = lf.Id JOIN payableinvoices pi ON pi.Id = lfu.PayableInvoiceId""")
def q_lease_invoices(spark, d):
    t = T(spark, d)
    return K.lease_invoices(t["leasefinances"], t["leasefundings"], t["payableinvoices"])


_PROFILE = "cu.FirstName, cu.LastName, cu.AddressLine1, cu.AddressLine2, cu.Zip, cu.Phone, cu.Email"


@query("contract_customer", f"""
SELECT lf.ContractId, {_PROFILE} FROM customers cu JOIN leasefinances lf ON lf.CustomerId = cu.Id
UNION
SELECT ln.ContractId, {_PROFILE} FROM customers cu JOIN loanfinances ln ON ln.CustomerId = cu.Id""")
def q_contract_customer(spark, d):
    t = T(spark, d)
    return K.contract_customer(t["leasefinances"], t["loanfinances"], t["customers"])


_INVOICE_TOTALS_SQL = """
SELECT lf.ContractId, COUNT(pi.Id) AS InvoiceCount, CAST(SUM(pi.InvoiceAmount) AS DECIMAL(18,2)) AS InvoiceAmount,
  CAST(SUM(pi.InvoiceTaxAmount) AS DECIMAL(18,2)) AS InvoiceTaxAmount
FROM leasefinances lf JOIN leasefundings lfu ON lfu.LeaseFinanceId = lf.Id JOIN payableinvoices pi ON pi.Id = lfu.PayableInvoiceId
GROUP BY lf.ContractId HAVING COUNT(pi.Id) > 0"""

_OUTSTANDING_SQL = f"""
SELECT r.EntityId AS ContractId, CAST(SUM(rd.Balance) AS DECIMAL(18,2)) AS OutstandingTotal
FROM receivables r JOIN receivabledetails rd ON rd.ReceivableId = r.Id
WHERE r.EntityType = 'CT' AND r.IsActive AND r.DueDate <= {AS_OF_SQL}
  AND rd.BillingStatus NOT IN ('Paid', 'Suppressed', 'Suspended') AND rd.Balance > 0
GROUP BY r.EntityId"""

PORTFOLIO_SQL = f"""
SELECT c.SequenceNumber, c.ContractType, COALESCE(c.Status, 'not yet commenced') AS Status, c.WorkflowStatus,
  nd.NextDueDate, CAST(nd.Amount + nd.TaxAmount AS DECIMAL(18,2)) AS NextDueTotal,
  COALESCE(inv.InvoiceCount, 0) AS InvoiceCount, inv.InvoiceAmount, inv.InvoiceTaxAmount,
  CAST(COALESCE(os.OutstandingTotal, 0) AS DECIMAL(18,2)) AS OutstandingTotal
FROM contracts c
LEFT JOIN ({_NEXT_DUE_SQL}) nd ON nd.ContractId = c.Id
LEFT JOIN ({_INVOICE_TOTALS_SQL}) inv ON inv.ContractId = c.Id
LEFT JOIN ({_OUTSTANDING_SQL}) os ON os.ContractId = c.Id
ORDER BY c.SequenceNumber"""


@query("portfolio_report", PORTFOLIO_SQL)
def q_portfolio_report(spark, d):
    return K.portfolio_report(T(spark, d))


# --- A: aggregates --------------------------------------------------------------------
@query("unbilled_schedule", _SCHEDULE_SQL)
def q_unbilled_schedule(spark, d):
    t = T(spark, d)
    return K.unbilled_schedule(t["receivables"], t["receivabledetails"])


@query("next_due_date", _NEXT_DUE_SQL)
def q_next_due_date(spark, d):
    t = T(spark, d)
    return K.next_due_date(t["receivables"], t["receivabledetails"])


@query("invoice_amount", """
SELECT lf.ContractId, pi.Currency, COUNT(pi.Id) AS InvoiceCount, CAST(SUM(pi.InvoiceAmount) AS DECIMAL(18,2)) AS InvoiceAmount,
  CAST(SUM(pi.InvoiceTaxAmount) AS DECIMAL(18,2)) AS InvoiceTaxAmount
FROM leasefinances lf JOIN leasefundings lfu ON lfu.LeaseFinanceId = lf.Id JOIN payableinvoices pi ON pi.Id = lfu.PayableInvoiceId
GROUP BY lf.ContractId, pi.Currency""")
def q_invoice_amount(spark, d):
    t = T(spark, d)
    return K.invoice_amount(t["leasefinances"], t["leasefundings"], t["payableinvoices"])


@query("invoice_totals_having", _INVOICE_TOTALS_SQL)
def q_invoice_totals_having(spark, d):
    t = T(spark, d)
    return K.invoice_totals(t["leasefinances"], t["leasefundings"], t["payableinvoices"])


@query("outstanding_amount", f"""
SELECT c.Id AS ContractId, CAST(COALESCE(os.OutstandingTotal, 0) AS DECIMAL(18,2)) AS OutstandingTotal
FROM contracts c LEFT JOIN ({_OUTSTANDING_SQL}) os ON os.ContractId = c.Id""")
def q_outstanding_amount(spark, d):
    t = T(spark, d)
    return K.outstanding_amount(t["contracts"], t["receivables"], t["receivabledetails"])


@query("paid_receivable_count", """
SELECT c.Id AS ContractId, COALESCE(p.PaidReceivables, 0) AS PaidReceivables FROM contracts c LEFT JOIN (
  SELECT r.EntityId AS ContractId, COUNT(DISTINCT r.Id) AS PaidReceivables
  FROM receivables r JOIN receivabledetails rd ON rd.ReceivableId = r.Id
  WHERE r.EntityType = 'CT' AND r.IsActive AND rd.BillingStatus = 'Paid' GROUP BY r.EntityId) p ON p.ContractId = c.Id""")
def q_paid_receivable_count(spark, d):
    t = T(spark, d)
    return K.paid_receivable_count(t["contracts"], t["receivables"], t["receivabledetails"])


@query("last_due_date", f"""
SELECT c.Id AS ContractId, x.LastDueDate FROM contracts c LEFT JOIN (
  SELECT r.EntityId AS ContractId, MAX(r.DueDate) AS LastDueDate FROM receivables r
  WHERE r.EntityType = 'CT' AND r.IsActive AND r.DueDate <= {AS_OF_SQL} GROUP BY r.EntityId) x ON x.ContractId = c.Id""")
def q_last_due_date(spark, d):
    t = T(spark, d)
    return K.last_due_date(t["contracts"], t["receivables"])


@query("receivable_count", """
SELECT c.Id AS ContractId, COALESCE(x.n, 0) AS ReceivableCount FROM contracts c LEFT JOIN (
  SELECT r.EntityId AS ContractId, COUNT(*) AS n FROM receivables r WHERE r.EntityType = 'CT' GROUP BY r.EntityId) x
  ON x.ContractId = c.Id""")
def q_receivable_count(spark, d):
    t = T(spark, d)
    return K.receivable_count(t["contracts"], t["receivables"])


@query("blocked_line_count", """
SELECT c.Id AS ContractId, COALESCE(x.n, 0) AS BlockedLines FROM contracts c LEFT JOIN (
  SELECT r.EntityId AS ContractId, COUNT(*) AS n FROM receivables r JOIN receivabledetails rd ON rd.ReceivableId = r.Id
  WHERE r.EntityType = 'CT' AND r.IsActive AND rd.BillingStatus IN ('Suppressed', 'Suspended') GROUP BY r.EntityId) x
  ON x.ContractId = c.Id""")
def q_blocked_line_count(spark, d):
    t = T(spark, d)
    return K.blocked_line_count(t["contracts"], t["receivables"], t["receivabledetails"])


@query("overdue_receivables", f"""
SELECT r.EntityId AS ContractId, r.DueDate, CAST(SUM(rd.Balance) AS DECIMAL(18,2)) AS Balance
FROM receivables r JOIN receivabledetails rd ON rd.ReceivableId = r.Id
WHERE r.EntityType = 'CT' AND r.IsActive AND r.DueDate <= {AS_OF_SQL}
  AND rd.BillingStatus NOT IN ('Paid', 'Suppressed', 'Suspended') AND rd.Balance > 0
GROUP BY r.EntityId, r.DueDate ORDER BY 1, 2""")
def q_overdue_receivables(spark, d):
    t = T(spark, d)
    return K.overdue_receivables(t["receivables"], t["receivabledetails"])


@query("invoice_max_final_due", """
SELECT c.Id AS ContractId, i.LargestInvoice, f.FinalDueDate FROM contracts c
LEFT JOIN (SELECT lf.ContractId, MAX(pi.InvoiceAmount) AS LargestInvoice FROM leasefinances lf
           JOIN leasefundings lfu ON lfu.LeaseFinanceId = lf.Id JOIN payableinvoices pi ON pi.Id = lfu.PayableInvoiceId
           GROUP BY lf.ContractId) i ON i.ContractId = c.Id
LEFT JOIN (SELECT r.EntityId AS ContractId, MAX(r.DueDate) AS FinalDueDate FROM receivables r
           WHERE r.EntityType = 'CT' AND r.IsActive GROUP BY r.EntityId) f ON f.ContractId = c.Id""")
def q_invoice_max_final_due(spark, d):
    t = T(spark, d)
    return K.invoice_max_final_due(t["contracts"], t["receivables"], t["leasefinances"], t["leasefundings"],
                                   t["payableinvoices"])


# --- U: set operations ----------------------------------------------------------------
@query("customer_union", """
SELECT cu.FirstName, cu.LastName, cu.CustomerType FROM customers cu JOIN leasefinances lf ON lf.CustomerId = cu.Id
UNION
SELECT cu.FirstName, cu.LastName, cu.CustomerType FROM customers cu JOIN loanfinances ln ON ln.CustomerId = cu.Id""")
def q_customer_union(spark, d):
    t = T(spark, d)
    return K.customer_union(t["leasefinances"], t["loanfinances"], t["customers"])


@query("customers_both_and_one_side", """
SELECT CustomerId, 'both' AS Side FROM (SELECT CustomerId FROM leasefinances INTERSECT SELECT CustomerId FROM loanfinances) a
UNION ALL
SELECT CustomerId, 'lease_only' AS Side FROM (SELECT CustomerId FROM leasefinances EXCEPT SELECT CustomerId FROM loanfinances) b""")
def q_customers_both_and_one_side(spark, d):
    t = T(spark, d)
    return K.customers_both_and_one_side(t["leasefinances"], t["loanfinances"])


# --- DQ: data quality -----------------------------------------------------------------
def _k(cols):
    return " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), 'NULL')" for c in cols)


def _dq_keys_sql() -> str:
    parts = []
    for table, keysets in Q.KEYS.items():
        for cols in keysets:
            nulls = " OR ".join(f"{c} IS NULL" for c in cols)
            label = ",".join(cols)
            parts.append(f"SELECT 'null_key' AS \"Check\", '{table}' AS TableName, {_k(cols)} AS RowKey, '{label}' AS Detail "
                         f"FROM {table} WHERE {nulls}")
            parts.append(f"SELECT 'duplicate_key', '{table}', {_k(cols)}, '{label} x' || CAST(COUNT(*) AS VARCHAR) "
                         f"FROM {table} GROUP BY {', '.join(cols)} HAVING COUNT(*) > 1")
    return "\nUNION ALL ".join(parts)


def _dq_enums_sql() -> str:
    parts = []
    for (table, col), allowed in Q.ENUMS.items():
        vals = ", ".join(f"'{v}'" for v in allowed)
        parts.append(f"SELECT 'enum' AS \"Check\", '{table}' AS TableName, {_k(Q.ROW_KEY[table])} AS RowKey, "
                     f"'{col}=' || {col} AS Detail FROM {table} WHERE {col} NOT IN ({vals})")
    return "\nUNION ALL ".join(parts)


def _dq_fk_sql() -> str:
    parts = []
    for child, fk, parent, pk in Q.FOREIGN_KEYS:
        parts.append(f"SELECT 'foreign_key' AS \"Check\", '{child}' AS TableName, {_k(Q.ROW_KEY[child])} AS RowKey, "
                     f"'{fk}->{parent}.{pk}=' || CAST({fk} AS VARCHAR) AS Detail FROM {child} x "
                     f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = x.{fk})")
    return "\nUNION ALL ".join(parts)


_RD_KEY = _k(Q.ROW_KEY["receivabledetails"])


@query("dq_keys", _dq_keys_sql())
def q_dq_keys(spark, d):
    return Q.dq_keys(T(spark, d))


@query("dq_enums", _dq_enums_sql())
def q_dq_enums(spark, d):
    return Q.dq_enums(T(spark, d))


@query("dq_foreign_keys", _dq_fk_sql())
def q_dq_foreign_keys(spark, d):
    return Q.dq_foreign_keys(T(spark, d))


@query("dq_balance_range", f"""
SELECT 'balance_range' AS "Check", 'receivabledetails' AS TableName, {_RD_KEY} AS RowKey,
  'Balance=' || CAST(Balance AS VARCHAR) AS Detail
FROM receivabledetails WHERE Balance < 0 OR Balance > Amount + TaxAmount""")
def q_dq_balance_range(spark, d):
    return Q.dq_balance_range(T(spark, d)["receivabledetails"])


@query("dq_paid_balance", f"""
SELECT 'paid_balance' AS "Check", 'receivabledetails' AS TableName, {_RD_KEY} AS RowKey,
  'Balance=' || CAST(Balance AS VARCHAR) AS Detail
FROM receivabledetails WHERE BillingStatus = 'Paid' AND Balance <> 0""")
def q_dq_paid_balance(spark, d):
    return Q.dq_paid_balance(T(spark, d)["receivabledetails"])


@query("dq_no_details", """
SELECT 'no_details' AS "Check", 'receivables' AS TableName, CAST(Id AS VARCHAR) AS RowKey, 'no detail rows' AS Detail
FROM receivables r WHERE NOT EXISTS (SELECT 1 FROM receivabledetails d WHERE d.ReceivableId = r.Id)""")
def q_dq_no_details(spark, d):
    t = T(spark, d)
    return Q.dq_no_details(t["receivables"], t["receivabledetails"])


@query("dq_rollup_mismatch", """
SELECT 'rollup_mismatch' AS "Check", 'receivables' AS TableName, CAST(r.Id AS VARCHAR) AS RowKey,
  'Amount=' || CAST(r.Amount AS VARCHAR) || ' details=' || CAST(d.A AS VARCHAR) AS Detail
FROM receivables r JOIN (SELECT ReceivableId, CAST(SUM(Amount) AS DECIMAL(18,2)) AS A, CAST(SUM(TaxAmount) AS DECIMAL(18,2)) AS T
  FROM receivabledetails GROUP BY ReceivableId) d ON d.ReceivableId = r.Id
WHERE r.Amount <> d.A OR r.TaxAmount <> d.T""")
def q_dq_rollup_mismatch(spark, d):
    t = T(spark, d)
    return Q.dq_rollup_mismatch(t["receivables"], t["receivabledetails"])


_FINANCE_TYPE_SQL = """
SELECT 'finance_type' AS "Check", 'contracts' AS TableName, CAST(c.Id AS VARCHAR) AS RowKey,
  c.ContractType || ' lease=' || CAST(lf IS NOT NULL AS VARCHAR) || ' loan=' || CAST(ln IS NOT NULL AS VARCHAR) AS Detail
FROM contracts c
LEFT JOIN (SELECT DISTINCT ContractId AS lf FROM leasefinances) a ON a.lf = c.Id
LEFT JOIN (SELECT DISTINCT ContractId AS ln FROM loanfinances) b ON b.ln = c.Id
WHERE (c.ContractType = 'Lease' AND (lf IS NULL OR ln IS NOT NULL))
   OR (c.ContractType = 'Loan' AND (ln IS NULL OR lf IS NOT NULL))"""


@query("dq_finance_type", _FINANCE_TYPE_SQL)
def q_dq_finance_type(spark, d):
    t = T(spark, d)
    return Q.dq_finance_type(t["contracts"], t["leasefinances"], t["loanfinances"])


@query("dq_orphan_ct", """
SELECT 'orphan_ct' AS "Check", 'receivables' AS TableName, CAST(r.Id AS VARCHAR) AS RowKey,
  'EntityId=' || CAST(r.EntityId AS VARCHAR) AS Detail
FROM receivables r WHERE r.EntityType = 'CT' AND NOT EXISTS (SELECT 1 FROM contracts c WHERE c.Id = r.EntityId)""")
def q_dq_orphan_ct(spark, d):
    t = T(spark, d)
    return Q.dq_orphan_ct(t["receivables"], t["contracts"])


_MUTATED_CTES = (
    ("m_receivabledetails", """SELECT ReceivableId, IsTaxAssessed, BillingStatus, DueDate, Amount, TaxAmount,
    CASE WHEN BillingStatus = 'Paid' THEN Amount ELSE Balance END AS Balance FROM receivabledetails"""),
    ("m_receivables", """SELECT Id, EntityId, CASE WHEN EntityType = 'SU' THEN 'XX' ELSE EntityType END AS EntityType,
    CASE WHEN NOT IsActive THEN CAST(Amount + 0.01 AS DECIMAL(18,2)) ELSE Amount END AS Amount, TaxAmount, DueDate, IsActive
    FROM receivables"""),
    ("m_contracts", """SELECT Id, SequenceNumber, Status, WorkflowStatus, CommencementDate,
    CASE WHEN Status = 'Restructure' THEN CASE WHEN ContractType = 'Lease' THEN 'Loan' ELSE 'Lease' END ELSE ContractType END
    AS ContractType FROM contracts"""),
)


def _mutation_sql() -> str:
    import re
    body = "\nUNION ALL ".join([
        _dq_enums_sql(),
        "SELECT 'paid_balance', 'receivabledetails', " + _RD_KEY + ", 'Balance=' || CAST(Balance AS VARCHAR) "
        "FROM receivabledetails WHERE BillingStatus = 'Paid' AND Balance <> 0",
        """SELECT 'rollup_mismatch', 'receivables', CAST(r.Id AS VARCHAR),
  'Amount=' || CAST(r.Amount AS VARCHAR) || ' details=' || CAST(d.A AS VARCHAR)
FROM receivables r JOIN (SELECT ReceivableId, CAST(SUM(Amount) AS DECIMAL(18,2)) AS A, CAST(SUM(TaxAmount) AS DECIMAL(18,2)) AS T
  FROM receivabledetails GROUP BY ReceivableId) d ON d.ReceivableId = r.Id WHERE r.Amount <> d.A OR r.TaxAmount <> d.T""",
        _FINANCE_TYPE_SQL.strip(),
    ])
    body = re.sub(r"(?<!')\b(receivabledetails|receivables|contracts)\b(?!')", r"m_\1", body)
    body = (f"SELECT \"Check\", TableName, COUNT(*) AS Violations FROM (\n{body}\n) v GROUP BY \"Check\", TableName")
    return with_views(body, *_MUTATED_CTES)


@query("dq_mutation_report", None)
def q_dq_mutation_report(spark, d):
    """Checks on a deliberately broken copy: proves enum, paid-balance, roll-up and finance-type fire."""
    m = Q.mutated_tables(T(spark, d))
    v = Q.dq_enums(m).unionByName(Q.dq_paid_balance(m["receivabledetails"])) \
        .unionByName(Q.dq_rollup_mismatch(m["receivables"], m["receivabledetails"])) \
        .unionByName(Q.dq_finance_type(m["contracts"], m["leasefinances"], m["loanfinances"]))
    return v.groupBy("Check", "TableName").agg(F.count(F.lit(1)).alias("Violations"))


REGISTRY["dq_mutation_report"] = (q_dq_mutation_report, _mutation_sql())


_BROKEN_CTES = (
    ("m_contracts", """SELECT Id, CASE WHEN Status = 'Rebook' THEN NULL ELSE SequenceNumber END AS SequenceNumber, Status, WorkflowStatus,
    CommencementDate, ContractType FROM contracts"""),
    ("m_receivables", """SELECT Id, CASE WHEN EntityType = 'CT' AND NOT IsActive THEN -EntityId ELSE EntityId END AS EntityId, EntityType,
    Amount, TaxAmount, DueDate, IsActive FROM receivables UNION ALL
    SELECT Id, EntityId, EntityType, Amount, TaxAmount, DueDate, IsActive FROM receivables WHERE EntityType = 'SU'"""),
    ("m_receivabledetails", """SELECT ReceivableId, IsTaxAssessed, BillingStatus, DueDate, Amount, TaxAmount,
    CASE WHEN BillingStatus = 'Suspended' THEN CAST(Amount + TaxAmount + 1 AS DECIMAL(18,2)) ELSE Balance END AS Balance
    FROM receivabledetails WHERE BillingStatus <> 'Suppressed'"""),
    ("m_leasefinances", "SELECT * REPLACE (CASE WHEN ContractId % 2 = 0 THEN -CustomerId ELSE CustomerId END AS CustomerId) FROM leasefinances"),
)


def _broken_sql() -> str:
    import re
    body = "\nUNION ALL ".join([_dq_keys_sql(), _dq_fk_sql(), *(REGISTRY[q][1].partition("SELECT '")[1] + REGISTRY[q][1].partition("SELECT '")[2]
                                                               for q in ("dq_balance_range", "dq_no_details", "dq_orphan_ct"))])
    body = re.sub(r"(?<!')\b(receivabledetails|receivables|contracts|leasefinances)\b(?!')", r"m_\1", body)
    return with_views(f"SELECT \"Check\", TableName, COUNT(*) AS Violations FROM (\n{body}\n) v GROUP BY \"Check\", TableName", *_BROKEN_CTES)


@query("dq_broken_report", None)
def q_dq_broken_report(spark, d):
    """Checks that clean data keep silent, on a copy broken in keys, references, balances and details."""
    m = Q.broken_tables(T(spark, d))
    v = (Q.dq_keys(m).unionByName(Q.dq_foreign_keys(m)).unionByName(Q.dq_balance_range(m["receivabledetails"]))
         .unionByName(Q.dq_no_details(m["receivables"], m["receivabledetails"])).unionByName(Q.dq_orphan_ct(m["receivables"], m["contracts"])))
    return v.groupBy("Check", "TableName").agg(F.count(F.lit(1)).alias("Violations"))


REGISTRY["dq_broken_report"] = (q_dq_broken_report, _broken_sql())


# --- R2 / E1 --------------------------------------------------------------------------
_OPEN = """r.EntityType = 'CT' AND r.IsActive AND rd.BillingStatus NOT IN ('Paid', 'Suppressed', 'Suspended') AND rd.Balance > 0"""
ANSWERS_SQL = f"""
SELECT * FROM (WITH q AS (SELECT s.request_id, s.seq, s.intent, s.as_of, c.Id, c.Status, c.WorkflowStatus FROM requests s LEFT JOIN contracts c ON c.SequenceNumber = trim(s.seq)),
sched AS (
  SELECT r.EntityId AS Id, rd.DueDate, CAST(SUM(rd.Amount) AS DECIMAL(18,2)) AS a, CAST(SUM(rd.TaxAmount) AS DECIMAL(18,2)) AS x
  FROM receivables r JOIN receivabledetails rd ON rd.ReceivableId = r.Id
  WHERE r.EntityType = 'CT' AND r.IsActive AND rd.BillingStatus = 'NotInvoiced' AND NOT rd.IsTaxAssessed GROUP BY ALL),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Id ORDER BY DueDate) AS k FROM sched) z WHERE k = 1),
inv AS (
  SELECT lf.ContractId AS Id, pi.Currency, COUNT(*) AS k, CAST(SUM(pi.InvoiceAmount) AS DECIMAL(18,2)) AS a, CAST(SUM(pi.InvoiceTaxAmount) AS DECIMAL(18,2)) AS x
  FROM leasefinances lf JOIN leasefundings lfu ON lfu.LeaseFinanceId = lf.Id JOIN payableinvoices pi ON pi.Id = lfu.PayableInvoiceId GROUP BY ALL),
invs AS (SELECT Id, list_sort(list('{{"InvoiceCount":' || k || ',"Currency":"' || Currency || '","InvoiceAmount":"' || a || '","InvoiceTaxAmount":"' || x || '"}}')) AS rows FROM inv GROUP BY Id),
o AS (
  SELECT q.request_id, CAST(SUM(rd.Balance) AS DECIMAL(18,2)) AS b FROM q JOIN receivables r ON r.EntityId = q.Id AND r.DueDate <= q.as_of
  JOIN receivabledetails rd ON rd.ReceivableId = r.Id WHERE q.intent = 'outstanding_amount' AND {_OPEN} GROUP BY q.request_id),
a AS (
  SELECT q.*, CASE WHEN q.Id IS NULL THEN 'not_found' WHEN q.intent = 'adhoc' THEN 'gave_up' ELSE 'answered' END AS outcome,
    CASE q.intent
      WHEN 'status' THEN ['{{"Status":"' || coalesce(q.Status, 'Not yet commenced') || '","WorkflowStatus":"' || q.WorkflowStatus || '"}}']
      WHEN 'next_due_date' THEN CASE WHEN n.Id IS NULL THEN [] ELSE ['{{"NextDueDate":"' || CAST(n.DueDate AS VARCHAR) || '","Amount":"' || n.a || '","TaxAmount":"' || n.x || '"}}'] END
      WHEN 'invoice_amount' THEN coalesce(invs.rows, [])
      WHEN 'outstanding_amount' THEN ['{{"OutstandingTotal":"' || coalesce(o.b, CAST(0 AS DECIMAL(18,2))) || '"}}'] END AS rows
  FROM q LEFT JOIN n ON n.Id = q.Id LEFT JOIN invs ON invs.Id = q.Id LEFT JOIN o ON o.request_id = q.request_id)
SELECT request_id, seq, intent, outcome, CAST(CASE WHEN outcome = 'answered' THEN len(rows) ELSE 0 END AS BIGINT) AS row_count,
  CASE WHEN outcome = 'answered' THEN '[' || array_to_string(rows, ',') || ']' END AS rows_json
FROM a) answers"""


@query("answer_requests", ANSWERS_SQL)
def q_answer_requests(spark, d):
    t = T(spark, d)
    return K.answer_requests(t["requests"], t)


@query("golden_diff", None)
def q_golden_diff(spark, d):
    from ledgerguard.operators.evaluate import report_vs_templates
    return report_vs_templates(T(spark, d))
