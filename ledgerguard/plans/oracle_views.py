"""DuckDB text of the contract-table mapping, used as CTEs by every oracle query.

Same definitions as ``ledgerguard.sources.tables`` (DataFrame form); the driver runs the oracle SQL
with the raw driver tables registered as views.
"""

VIEW_SQL: dict[str, str] = {
    "contracts": """
SELECT o_orderkey AS Id, 'CT-' || CAST(o_orderkey AS VARCHAR) AS SequenceNumber,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL WHEN o_orderstatus = 'F' THEN 'PaidOff'
       WHEN o_orderstatus = 'P' THEN 'Restructure' WHEN o_orderpriority = '5-LOW' THEN 'Rebook'
       ELSE 'Commenced' END AS Status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Commenced' WHEN '2-HIGH' THEN 'Approved' WHEN '3-MEDIUM' THEN 'Submitted'
       WHEN '4-NOT SPECIFIED' THEN 'Documents Submitted' ELSE 'Documents Revision' END AS WorkflowStatus,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS CommencementDate,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Loan' ELSE 'Lease' END AS ContractType
FROM orders""",
    "customers": """
SELECT c_custkey AS Id, 'Fn' || CAST(c_custkey AS VARCHAR) AS FirstName,
  CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 'Ln' || CAST(c_nationkey AS VARCHAR) END AS LastName,
  CASE WHEN c_nationkey % 2 = 0 THEN 'Individual' ELSE 'Business' END AS CustomerType,
  CAST(c_custkey AS VARCHAR) || ' Market Street' AS AddressLine1,
  CASE WHEN c_custkey % 3 = 0 THEN 'Unit ' || CAST(c_nationkey AS VARCHAR) ELSE NULL END AS AddressLine2,
  lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS Zip,
  '900-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS SSN,
  '555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS Phone,
  'fn' || CAST(c_custkey AS VARCHAR) || '@example.com' AS Email
FROM customer""",
    "leasefinances": """
SELECT o_orderkey AS Id, o_orderkey AS ContractId, 'Commenced' AS Status, CAST(o_orderdate AS DATE) AS BookingDate,
  CAST(o_totalprice AS DECIMAL(18,2)) AS DownPayment, o_custkey AS CustomerId
FROM orders WHERE o_orderkey % 3 <> 0""",
    "loanfinances": """
SELECT o_orderkey AS Id, o_orderkey AS ContractId, 'Commenced' AS Status, CAST(o_orderdate AS DATE) AS BookingDate,
  o_custkey AS CustomerId
FROM orders WHERE o_orderkey % 3 = 0""",
    "payableinvoices": """
SELECT p_partkey AS Id, CAST(p_retailprice AS DECIMAL(18,2)) AS InvoiceAmount, 'Paid' AS Status,
  DATE '1998-01-01' AS InvoiceDate, CAST(p_size AS DECIMAL(18,2)) AS InvoiceTaxAmount,
  CASE WHEN p_partkey % 4 = 0 THEN 'EUR' ELSE 'USD' END AS Currency
FROM part""",
    "leasefundings": """
SELECT DISTINCT l_orderkey AS LeaseFinanceId, l_partkey AS PayableInvoiceId FROM lineitem WHERE l_orderkey % 3 <> 0""",
    "receivabledetails": """
SELECT ReceivableId, IsTaxAssessed, BillingStatus, DueDate, Amount, TaxAmount,
  CAST(CASE WHEN BillingStatus = 'Paid' THEN 0 WHEN partial THEN Amount ELSE Amount + TaxAmount END AS DECIMAL(18,2)) AS Balance
FROM (
  SELECT l_orderkey * 8 + l_linenumber AS ReceivableId, l_partkey % 5 = 0 AS IsTaxAssessed,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Paid' WHEN l_returnflag = 'A' THEN 'Suspended'
         WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Suppressed' WHEN l_returnflag = 'R' THEN 'NotInvoiced'
         ELSE 'Invoiced' END AS BillingStatus,
    CAST(l_shipdate AS DATE) AS DueDate, CAST(l_extendedprice AS DECIMAL(18,2)) AS Amount,
    CAST(l_quantity AS DECIMAL(18,2)) AS TaxAmount, l_discount >= 0.05 AS partial
  FROM lineitem) x""",
    "receivables": """
SELECT l_orderkey * 8 + l_linenumber AS Id, l_orderkey AS EntityId,
  CASE WHEN l_linenumber = 7 THEN 'SU' ELSE 'CT' END AS EntityType,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS Amount,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS TaxAmount,
  CAST(min(l_shipdate) AS DATE) AS DueDate, (l_orderkey + l_linenumber) % 11 <> 0 AS IsActive
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "contract_notes": """
SELECT o.o_orderkey AS ContractId, o.o_custkey AS CustomerId,
  'Reach ' || upper(c.FirstName) || ' ' || coalesce(c.LastName, 'Inc') || ' at ' || c.Email || ' or ' || c.Phone
  || ', ssn ' || c.SSN || ', card 4111 1111 1111 111' || CAST(o.o_orderkey % 10 AS VARCHAR)
  || ' re CT-' || CAST(o.o_orderkey AS VARCHAR) AS note
FROM orders o JOIN customers c ON c.Id = o.o_custkey""",
    "requests": """
SELECT c_custkey AS request_id, ' CT-' || CAST(c_custkey * 11 AS VARCHAR) || ' ' AS seq,
  ['status', 'next_due_date', 'invoice_amount', 'outstanding_amount', 'adhoc'][c_custkey % 5 + 1] AS intent,
  CAST(DATE '1998-10-01' - CAST(c_custkey % 400 AS INTEGER) AS DATE) AS as_of
FROM customer""",
}

# Order matters: contract_notes reads customers.
VIEW_ORDER = ("contracts", "customers", "leasefinances", "loanfinances", "payableinvoices", "leasefundings",
              "receivabledetails", "receivables", "contract_notes", "requests")


def with_views(body: str, *extra_ctes: tuple[str, str]) -> str:
    """Prefix ``body`` with the contract views (and extra named CTEs) it references."""
    import re
    needed = [v for v in VIEW_ORDER if re.search(rf"\b{v}\b", body) or any(re.search(rf"\b{v}\b", s) for _, s in extra_ctes)]
    if "contract_notes" in needed and "customers" not in needed:
        needed.insert(0, "customers")
    ctes = [f"{v} AS ({VIEW_SQL[v]}\n)" for v in VIEW_ORDER if v in needed]
    ctes += [f"{name} AS ({sql}\n)" for name, sql in extra_ctes]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
