"""Contract answers for every contract in one job.

The reference answers one contract per call with parameterised SQL. Here each question is a
DataFrame over all contracts: the per-contract ``WHERE EntityId = :contract_id`` becomes a
grouping (or join) key, ``TOP 1 ... ORDER BY`` becomes a ``min`` over a struct, and the
aggregate-without-GROUP-BY semantics ("always one row, 0 when empty") become a left join from
Contracts with ``coalesce``. All functions take and return DataFrames; nothing is collected.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.sources.tables import AS_OF, MONEY

# Fixed values (business vocabulary of the contract model)
NOT_COMMENCED_TEMPLATE = "Not yet commenced"   # core status question
NOT_COMMENCED_REPORT = "not yet commenced"     # portfolio report
CLOSED_BILLING = ("Paid", "Suppressed", "Suspended")
BLOCKED_BILLING = ("Suppressed", "Suspended")
INTENTS = ("status", "next_due_date", "invoice_amount", "outstanding_amount", "adhoc")
CORE_INTENTS = INTENTS[:4]


def _money(c) -> F.Column:
    return c.cast(MONEY)


def _as_of(as_of: date | str | F.Column | None) -> F.Column:
    if isinstance(as_of, F.Column):
        return as_of
    return F.lit(as_of or AS_OF).cast("date")


# --- predicates (P3-P6) ----------------------------------------------------------------
def is_contract_receivable() -> F.Column:
    """Polymorphic receivables belong to a contract only with EntityType 'CT'; inactive ignored."""
    return (F.col("EntityType") == "CT") & F.col("IsActive")


def is_unbilled() -> F.Column:
    """The next-due rule: not invoiced yet and not a tax-assessed line."""
    return (F.col("BillingStatus") == "NotInvoiced") & ~F.col("IsTaxAssessed")


def is_due(as_of=None, col: str = "DueDate") -> F.Column:
    """P5: inclusive as-of boundary."""
    return F.col(col) <= _as_of(as_of)


def is_open_balance() -> F.Column:
    """Balances still owed (closed statuses excluded, zero balances skipped)."""
    return ~F.col("BillingStatus").isin(*CLOSED_BILLING) & (F.col("Balance") > 0)


def active_receivables(r: DataFrame) -> DataFrame:
    return r.where(is_contract_receivable())


def unbilled_details(rd: DataFrame) -> DataFrame:
    return rd.where(is_unbilled())


def due_as_of(r: DataFrame, as_of=None) -> DataFrame:
    return r.where(is_due(as_of))


def open_balance(rd: DataFrame) -> DataFrame:
    return rd.where(is_open_balance())


# --- Q1 / facts ------------------------------------------------------------------------
def contract_status(c: DataFrame) -> DataFrame:
    """P2 / core Q1."""
    return c.select(F.col("Id").alias("ContractId"), "SequenceNumber",
                    F.coalesce("Status", F.lit(NOT_COMMENCED_TEMPLATE)).alias("Status"), "WorkflowStatus")


def contract_facts(c: DataFrame, lf: DataFrame, ln: DataFrame, cu: DataFrame) -> DataFrame:
    """Single-contract attribute lookups, for all contracts (finance record by type)."""
    lf_ = lf.select(F.col("ContractId").alias("_lc"), F.col("BookingDate").alias("_lb"),
                    "DownPayment", F.col("CustomerId").alias("_lcu"))
    ln_ = ln.select(F.col("ContractId").alias("_nc"), F.col("BookingDate").alias("_nb"),
                    F.col("CustomerId").alias("_ncu"))
    cu_ = cu.select(F.col("Id").alias("_cu"), "CustomerType")
    return (c.join(lf_, c.Id == lf_._lc, "left").join(ln_, c.Id == ln_._nc, "left")
            .join(cu_, F.coalesce(F.col("_lcu"), F.col("_ncu")) == cu_._cu, "left")
            .select(F.col("Id").alias("ContractId"), "SequenceNumber", "CommencementDate", "ContractType",
                    "WorkflowStatus", F.coalesce("_lb", "_nb").alias("BookingDate"), "DownPayment",
                    "CustomerType"))


# --- receivable joins (J3) -------------------------------------------------------------
def receivable_details(r: DataFrame, rd: DataFrame, active_only: bool = True) -> DataFrame:
    """Details of (active, CT) receivables with the parent's entity and due date."""
    parent = (active_receivables(r) if active_only else r).select(
        F.col("Id").alias("ReceivableId"), F.col("EntityId").alias("ContractId"),
        F.col("DueDate").alias("ReceivableDueDate"))
    return parent.join(rd, "ReceivableId")


# --- Q2 next due (A1, W1, P7) ----------------------------------------------------------
def unbilled_schedule(r: DataFrame, rd: DataFrame) -> DataFrame:
    """A1: per (contract, detail due date) amount and tax of unbilled, untaxed lines."""
    return (receivable_details(r, unbilled_details(rd))
            .groupBy("ContractId", "DueDate")
            .agg(_money(F.sum("Amount")).alias("Amount"), _money(F.sum("TaxAmount")).alias("TaxAmount")))


def next_due_date(r: DataFrame, rd: DataFrame) -> DataFrame:
    """W1 / core Q2: earliest unbilled date per contract; no row when there is none.
    ``min(struct)`` is a per-contract top-1 without a window sort (partial aggregation map-side)."""
    first = F.min(F.struct("DueDate", "Amount", "TaxAmount")).alias("nd")
    return (unbilled_schedule(r, rd).groupBy("ContractId").agg(first)
            .select("ContractId", F.col("nd.DueDate").alias("NextDueDate"),
                    F.col("nd.Amount").alias("Amount"), F.col("nd.TaxAmount").alias("TaxAmount")))


def next_due_total(r: DataFrame, rd: DataFrame) -> DataFrame:
    """Amount + tax of the next due date."""
    return next_due_date(r, rd).select("ContractId", "NextDueDate",
                                       _money(F.col("Amount") + F.col("TaxAmount")).alias("NextDueTotal"))


# --- Q3 invoices (J4, A2, A10) ---------------------------------------------------------
def lease_invoices(lf: DataFrame, lfu: DataFrame, pi: DataFrame) -> DataFrame:
    """Lease finance -> funding bridge -> payable invoice."""
    return (lf.select(F.col("Id").alias("LeaseFinanceId"), "ContractId")
            .join(lfu, "LeaseFinanceId")
            .join(pi.withColumnRenamed("Id", "PayableInvoiceId"), "PayableInvoiceId")
            .select("ContractId", "PayableInvoiceId", "InvoiceAmount", "InvoiceTaxAmount", "Currency",
                    "InvoiceDate", F.col("Status").alias("InvoiceStatus")))


def _invoice_aggs():
    return (F.count("PayableInvoiceId").alias("InvoiceCount"),
            _money(F.sum("InvoiceAmount")).alias("InvoiceAmount"),
            _money(F.sum("InvoiceTaxAmount")).alias("InvoiceTaxAmount"))


def invoice_amount(lf: DataFrame, lfu: DataFrame, pi: DataFrame) -> DataFrame:
    """A2 / core Q3: per contract and currency; loans have no row."""
    return lease_invoices(lf, lfu, pi).groupBy("ContractId", "Currency").agg(*_invoice_aggs())


def invoice_totals(lf: DataFrame, lfu: DataFrame, pi: DataFrame) -> DataFrame:
    """A10: per contract without the currency split, only groups with at least one invoice."""
    return (lease_invoices(lf, lfu, pi).groupBy("ContractId").agg(*_invoice_aggs())
            .where(F.col("InvoiceCount") > 0))


# --- Q4 outstanding (A3) ---------------------------------------------------------------
def outstanding_by_contract(r: DataFrame, rd: DataFrame, as_of=None) -> DataFrame:
    """Sum of open balances of receivables due on/before as-of (parent due date), contracts with rows only."""
    j = receivable_details(r.where(is_due(as_of)), open_balance(rd))
    return j.groupBy("ContractId").agg(_money(F.sum("Balance")).alias("OutstandingTotal"))


def outstanding_amount(c: DataFrame, r: DataFrame, rd: DataFrame, as_of=None) -> DataFrame:
    """A3 / core Q4: one row for every contract, 0 when nothing is owed."""
    os_ = outstanding_by_contract(r, rd, as_of)
    return (c.select(F.col("Id").alias("ContractId")).join(os_, "ContractId", "left")
            .select("ContractId", _money(F.coalesce("OutstandingTotal", F.lit(0))).alias("OutstandingTotal")))


# --- ad-hoc aggregates (A4-A9) ---------------------------------------------------------
def _per_contract(c: DataFrame, agg: DataFrame, defaults: dict) -> DataFrame:
    """Aggregate-without-GROUP-BY semantics for every contract: one row each, defaults when empty."""
    out = c.select(F.col("Id").alias("ContractId")).join(agg, "ContractId", "left")
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def paid_receivable_count(c: DataFrame, r: DataFrame, rd: DataFrame) -> DataFrame:
    """A4: receivables with at least one Paid detail."""
    j = receivable_details(r, rd.where(F.col("BillingStatus") == "Paid"))
    agg = j.groupBy("ContractId").agg(F.countDistinct("ReceivableId").alias("PaidReceivables"))
    return _per_contract(c, agg, {"PaidReceivables": 0})


def last_due_date(c: DataFrame, r: DataFrame, as_of=None) -> DataFrame:
    """A5: latest receivable due date on/before as-of."""
    agg = (active_receivables(r).where(is_due(as_of))
           .groupBy(F.col("EntityId").alias("ContractId")).agg(F.max("DueDate").alias("LastDueDate")))
    return _per_contract(c, agg, {})


def receivable_count(c: DataFrame, r: DataFrame) -> DataFrame:
    """COUNT(*) of the contract's CT receivables (active or not)."""
    agg = (r.where(F.col("EntityType") == "CT").groupBy(F.col("EntityId").alias("ContractId"))
           .agg(F.count(F.lit(1)).alias("ReceivableCount")))
    return _per_contract(c, agg, {"ReceivableCount": 0})


def blocked_line_count(c: DataFrame, r: DataFrame, rd: DataFrame) -> DataFrame:
    """Detail lines that are suppressed or suspended."""
    j = receivable_details(r, rd.where(F.col("BillingStatus").isin(*BLOCKED_BILLING)))
    agg = j.groupBy("ContractId").agg(F.count(F.lit(1)).alias("BlockedLines"))
    return _per_contract(c, agg, {"BlockedLines": 0})


def overdue_receivables(r: DataFrame, rd: DataFrame, as_of=None, ordered: bool = True) -> DataFrame:
    """Per (contract, receivable due date) open balance, sorted for presentation unless it feeds another step."""
    j = receivable_details(r.where(is_due(as_of)), open_balance(rd))
    out = (j.groupBy("ContractId", F.col("ReceivableDueDate").alias("DueDate"))
           .agg(_money(F.sum("Balance")).alias("Balance")))
    return out.orderBy("ContractId", "DueDate") if ordered else out


def invoice_max_final_due(c: DataFrame, r: DataFrame, lf: DataFrame, lfu: DataFrame, pi: DataFrame) -> DataFrame:
    """Largest single payable invoice and final installment due date per contract."""
    inv = lease_invoices(lf, lfu, pi).groupBy("ContractId").agg(F.max("InvoiceAmount").alias("LargestInvoice"))
    fin = (active_receivables(r).groupBy(F.col("EntityId").alias("ContractId"))
           .agg(F.max("DueDate").alias("FinalDueDate")))
    return _per_contract(c, inv, {}).join(fin, "ContractId", "left")


# --- customer (J5, U1, U3) -------------------------------------------------------------
PROFILE_COLUMNS = ("FirstName", "LastName", "AddressLine1", "AddressLine2", "Zip", "Phone", "Email")


def _finance_customers(lf: DataFrame, ln: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (lf.select("ContractId", "CustomerId"), ln.select("ContractId", "CustomerId"))


def contract_customer(lf: DataFrame, ln: DataFrame, cu: DataFrame) -> DataFrame:
    """The customer profile (no SSN) of each contract, via the lease or the loan finance record;
    UNION (distinct) of both branches."""
    prof = cu.select(F.col("Id").alias("CustomerId"), *PROFILE_COLUMNS)
    a, b = _finance_customers(lf, ln)
    return (a.join(prof, "CustomerId").select("ContractId", *PROFILE_COLUMNS)
            .union(b.join(prof, "CustomerId").select("ContractId", *PROFILE_COLUMNS)).distinct())


def customer_union(lf: DataFrame, ln: DataFrame, cu: DataFrame) -> DataFrame:
    """Distinct (FirstName, LastName, CustomerType) of customers on lease ∪ loan records."""
    cols = ("FirstName", "LastName", "CustomerType")
    prof = cu.select(F.col("Id").alias("CustomerId"), *cols)
    a = lf.select("CustomerId").join(prof, "CustomerId").select(*cols)
    b = ln.select("CustomerId").join(prof, "CustomerId").select(*cols)
    return a.union(b).distinct()


def customers_both_and_one_side(lf: DataFrame, ln: DataFrame) -> DataFrame:
    """Customers holding both a lease and a loan (INTERSECT) and lease-only ones (EXCEPT)."""
    a, b = lf.select("CustomerId"), ln.select("CustomerId")
    both = a.intersect(b).withColumn("Side", F.lit("both"))
    lease_only = a.subtract(b).withColumn("Side", F.lit("lease_only"))
    return both.unionByName(lease_only)


# --- contract resolution (J1, J2, P9) --------------------------------------------------
def resolve_contracts(requests: DataFrame, c: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Stripped sequence number -> (ContractId, ContractType)."""
    cc = c.select(F.col("SequenceNumber").alias("_seq"), F.col("Id").alias("ContractId"), "ContractType")
    return requests.join(cc, F.trim(F.col(seq_col)) == cc._seq).drop("_seq")


def unknown_contracts(requests: DataFrame, c: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Requested sequence numbers with no contract (ContractNotFound)."""
    cc = c.select(F.col("SequenceNumber").alias("_seq"))
    return requests.join(cc, F.trim(F.col(seq_col)) == cc._seq, "left_anti")


def outstanding_as_of(pairs: DataFrame, r: DataFrame, rd: DataFrame) -> DataFrame:
    """Open balance of each (ContractId, as_of) pair, 0 when nothing is owed. The pairs (a batch of requests)
    meet the receivables first, so only theirs are joined to details."""
    pairs = pairs.select("ContractId", "as_of").distinct()
    owed = (active_receivables(r).select(F.col("Id").alias("ReceivableId"), F.col("EntityId").alias("ContractId"), "DueDate")
            .join(pairs, "ContractId").where(F.col("DueDate") <= F.col("as_of")).select("ReceivableId", "ContractId", "as_of")
            .join(open_balance(rd).select("ReceivableId", "Balance"), "ReceivableId")
            .groupBy("ContractId", "as_of").agg(F.sum("Balance").alias("OutstandingTotal")))
    return (pairs.join(owed, ["ContractId", "as_of"], "left")
            .select("ContractId", "as_of", _money(F.coalesce("OutstandingTotal", F.lit(0))).alias("OutstandingTotal")))


def outstanding_for_requests(requests: DataFrame, c: DataFrame, r: DataFrame, rd: DataFrame) -> DataFrame:
    """Bind (contract_id, as_of_date) per request row: each request has its own as-of."""
    req = resolve_contracts(requests, c).select("request_id", "ContractId", F.coalesce("as_of", _as_of(None)).alias("as_of"))
    return req.join(outstanding_as_of(req, r, rd), ["ContractId", "as_of"]).select("request_id", "ContractId", "OutstandingTotal")


# --- R1 portfolio report ---------------------------------------------------------------
def receivable_rollup(r: DataFrame, rd: DataFrame, as_of=None) -> DataFrame:
    """Next due (struct) and outstanding per contract from ONE join of receivables and details:
    conditional sums per (contract, detail due date), then a second small aggregation per contract."""
    j = receivable_details(r, rd.where(is_unbilled() | is_open_balance()))
    unbilled = is_unbilled()
    owed = is_open_balance() & is_due(as_of, "ReceivableDueDate")
    per_date = (j.where(unbilled | owed)
                .groupBy("ContractId", "DueDate")
                .agg(F.sum(F.when(unbilled, F.col("Amount"))).alias("a"),
                     F.sum(F.when(unbilled, F.col("TaxAmount"))).alias("t"),
                     F.max(unbilled.cast("int")).alias("has_unbilled"),
                     F.sum(F.when(owed, F.col("Balance"))).alias("owed")))
    nd = F.min(F.when(F.col("has_unbilled") == 1, F.struct("DueDate", "a", "t"))).alias("nd")
    return (per_date.groupBy("ContractId").agg(nd, F.sum("owed").alias("owed"))
            .select("ContractId", F.col("nd.DueDate").alias("NextDueDate"),
                    _money(F.col("nd.a")).alias("NextAmount"), _money(F.col("nd.t")).alias("NextTax"),
                    _money(F.col("owed")).alias("Owed")))


def portfolio_report(t: dict, as_of=None, ordered: bool = True) -> DataFrame:
    """R1 (flagship): one row per contract with status, next due, invoices and outstanding."""
    c, r, rd = t["contracts"], t["receivables"], t["receivabledetails"]
    roll = receivable_rollup(r, rd, as_of)
    inv = invoice_totals(t["leasefinances"], t["leasefundings"], t["payableinvoices"])
    out = (c.select(F.col("Id").alias("ContractId"), "SequenceNumber", "ContractType", "Status", "WorkflowStatus")
           .join(roll, "ContractId", "left").join(inv, "ContractId", "left")
           .select("SequenceNumber", "ContractType",
                   F.coalesce("Status", F.lit(NOT_COMMENCED_REPORT)).alias("Status"), "WorkflowStatus",
                   "NextDueDate", _money(F.col("NextAmount") + F.col("NextTax")).alias("NextDueTotal"),
                   F.coalesce("InvoiceCount", F.lit(0)).alias("InvoiceCount"), "InvoiceAmount", "InvoiceTaxAmount",
                   _money(F.coalesce("Owed", F.lit(0))).alias("OutstandingTotal")))
    return out.orderBy("SequenceNumber") if ordered else out


# --- R2 answer requests ----------------------------------------------------------------
def answer_requests(requests: DataFrame, t: dict) -> DataFrame:
    """R2: a batch of (request_id, seq, intent, as_of) -> (request_id, seq, intent, outcome, row_count,
    rows_json). Each intent is answered for the contracts (and, for balances, the dates) asked about only:
    the requested ids semi-join the base tables before any aggregate. Unknown contracts give
    ``not_found`` and non-core intents ``gave_up`` (no SQL generator here)."""
    opts = {"ignoreNullFields": "false"}
    cc = t["contracts"].select(F.col("SequenceNumber").alias("_seq"), F.col("Id").alias("ContractId"), "Status", "WorkflowStatus")
    req = (requests.join(cc, F.trim(F.col("seq")) == F.col("_seq"), "left")
           .select("request_id", "seq", "intent", "ContractId", "Status", "WorkflowStatus",
                   F.coalesce("as_of", _as_of(None)).alias("as_of")))

    def asked(intent: str) -> DataFrame:
        return req.where((F.col("intent") == intent) & F.col("ContractId").isNotNull()).select("ContractId", "as_of")

    def only(table: DataFrame, column: str, intent: str) -> DataFrame:
        ids = asked(intent).select(F.col("ContractId").alias("_id")).distinct()
        return table.join(ids, F.col(column) == F.col("_id"), "left_semi")

    def as_json(df: DataFrame, *cols) -> Column:
        return F.to_json(F.struct(*[F.col(x) if x == "InvoiceCount" else F.col(x).cast("string").alias(x) for x in cols]), opts)

    r, rd = t["receivables"], t["receivabledetails"]
    due = next_due_date(only(r, "EntityId", "next_due_date"), rd)
    invoices = invoice_amount(only(t["leasefinances"], "ContractId", "invoice_amount"), t["leasefundings"], t["payableinvoices"])
    owed = outstanding_as_of(asked("outstanding_amount"), r, rd)
    every_date = F.lit(None).cast("date")
    answers = (due.select("ContractId", every_date.alias("as_of"), F.lit("next_due_date").alias("intent"),
                          as_json(due, "NextDueDate", "Amount", "TaxAmount").alias("row"))
               .union(invoices.select("ContractId", every_date, F.lit("invoice_amount"),
                                      as_json(invoices, "InvoiceCount", "Currency", "InvoiceAmount", "InvoiceTaxAmount")))
               .union(owed.select("ContractId", "as_of", F.lit("outstanding_amount"), as_json(owed, "OutstandingTotal"))))
    # one row per contract, date and intent, or per currency for invoices: a handful
    answers = (answers.groupBy("ContractId", "as_of", "intent").agg(F.sort_array(F.collect_list("row")).alias("_rows"))
               .select(F.col("ContractId").alias("_c"), F.col("as_of").alias("_d"), F.col("intent").alias("_i"), "_rows"))
    dated = F.when(F.col("intent") == "outstanding_amount", F.col("as_of"))
    joined = req.join(answers, (F.col("ContractId") == F.col("_c")) & (F.col("intent") == F.col("_i")) & dated.eqNullSafe(F.col("_d")), "left")
    status = F.array(F.to_json(F.struct(F.coalesce("Status", F.lit(NOT_COMMENCED_TEMPLATE)).alias("Status"), "WorkflowStatus"), opts))
    rows = F.when(F.col("intent") == "status", status).otherwise(F.coalesce("_rows", F.array().cast("array<string>")))
    outcome = (F.when(F.col("ContractId").isNull(), "not_found").when(~F.col("intent").isin(*CORE_INTENTS), "gave_up").otherwise("answered"))
    return joined.select(
        "request_id", "seq", "intent", outcome.alias("outcome"),
        F.when(outcome == "answered", F.size(rows)).otherwise(0).cast("long").alias("row_count"),
        F.when(outcome == "answered", F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]"))).alias("rows_json"))
