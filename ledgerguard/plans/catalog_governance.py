"""Governance queries: scoped views, lineage, row masking, the governed report, conversation history,
audit records, evaluation and the scalar helpers."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions import patterns as P
from ledgerguard.functions import spans as S
from ledgerguard.functions import text as X
from ledgerguard.operators import adhoc as AD
from ledgerguard.operators import audit as A
from ledgerguard.operators import contracts as K
from ledgerguard.operators import evaluate as E
from ledgerguard.operators import masking as M
from ledgerguard.operators import scope as SC
from ledgerguard.operators import vault as V
from ledgerguard.operators.lineage import classify_output
from ledgerguard.plans import catalog_pii as CP
from ledgerguard.plans.catalog import ANSWERS_SQL, REGISTRY, T, query
from ledgerguard.plans.oracle_views import with_views
from ledgerguard.sources.policy import DEFAULT
from ledgerguard.sources.tables import CONTRACT_TABLES, register_views


def _tables(spark, d):
    t = T(spark, d)
    return {n: t[n] for n in CONTRACT_TABLES}


# --- J7 / J8 ---------------------------------------------------------------------------------
_CU_COLS = "Id, FirstName, LastName, CustomerType, AddressLine1, AddressLine2, Zip, Phone, Email"
_SCOPE_SQL = {
    "contracts": "SELECT Id AS contract_id, * FROM contracts",
    "leasefinances": "SELECT ContractId AS contract_id, * FROM leasefinances",
    "loanfinances": "SELECT ContractId AS contract_id, * FROM loanfinances",
    "receivables": "SELECT EntityId AS contract_id, * FROM receivables WHERE EntityType = 'CT'",
    "receivabledetails": """SELECT k.contract_id, rd.* FROM receivabledetails rd
  JOIN (SELECT DISTINCT EntityId AS contract_id, Id AS _k FROM receivables WHERE EntityType = 'CT') k ON rd.ReceivableId = k._k""",
    "customers": f"""SELECT DISTINCT k.contract_id, {', '.join('cu.' + c.strip() for c in _CU_COLS.split(','))} FROM customers cu
  JOIN (SELECT DISTINCT ContractId AS contract_id, CustomerId AS _k FROM leasefinances
        UNION ALL SELECT DISTINCT ContractId, CustomerId FROM loanfinances) k ON cu.Id = k._k""",
    "leasefundings": """SELECT k.contract_id, lfu.* FROM leasefundings lfu
  JOIN (SELECT DISTINCT ContractId AS contract_id, Id AS _k FROM leasefinances) k ON lfu.LeaseFinanceId = k._k""",
    "payableinvoices": """SELECT k.contract_id, pi.* FROM payableinvoices pi
  JOIN (SELECT DISTINCT lf.ContractId AS contract_id, lfu.PayableInvoiceId AS _k FROM leasefundings lfu
        JOIN leasefinances lf ON lfu.LeaseFinanceId = lf.Id) k ON pi.Id = k._k""",
}


def _scope_query(table):
    def fn(spark, d):
        return SC.contract_scope(_tables(spark, d))[table]
    return fn


for _t in CONTRACT_TABLES:
    REGISTRY[f"scope_{_t}"] = (_scope_query(_t), with_views(_SCOPE_SQL[_t]))


def _oos_sql() -> str:
    parts = []
    for t, keys in SC.ROW_KEYS.items():
        key = " || '|' || ".join(f"CAST(x.{k} AS VARCHAR)" for k in keys)
        cond = " AND ".join(f"s.{k} = x.{k}" for k in keys)
        parts.append(f"SELECT '{t}' AS TableName, {key} AS RowKey FROM {t} x "
                     f"WHERE NOT EXISTS (SELECT 1 FROM ({_SCOPE_SQL[t]}) s WHERE {cond})")
    return "\nUNION ALL ".join(parts)


@query("out_of_scope_rows", _oos_sql())
def q_out_of_scope_rows(spark, d):
    return SC.out_of_scope_rows(_tables(spark, d))


# --- M1 / M2 / M3 / R3 -----------------------------------------------------------------------
LINEAGE_CASES = {  # what each query's columns must be classified as is in the oracle
    "renamed": "SELECT FirstName AS given, Zip FROM customers",
    "filtered_only": "SELECT Id FROM customers WHERE SSN LIKE '9%'",
    "expression": "SELECT left(lower(Phone), 5) AS prefix, length(Email) AS n FROM customers",
    "nested": "SELECT max(p) AS latest FROM (SELECT reverse(Phone) AS p FROM customers) WHERE p LIKE '%1%'",
    "with_join": "WITH people AS (SELECT Id, upper(LastName) AS who FROM customers) SELECT a.who FROM people a JOIN people b ON a.Id = b.Id",
    "not_personal": "SELECT Status, WorkflowStatus FROM contracts",
    "shadowed_name": "SELECT customers.Email AS e FROM (SELECT SSN AS Email FROM customers) customers",
    "unpivoted": "SELECT v FROM customers UNPIVOT (v FOR c IN (SSN, Email))",
    "rolled_up": "SELECT Email AS mail FROM customers GROUP BY ROLLUP(Email)",
    "united": "SELECT Email AS x FROM customers UNION ALL SELECT SSN FROM customers",
    "scalar_subquery": "SELECT Id, (SELECT max(SSN) FROM customers) AS top FROM contracts",
}
RESTRICTED_CASES = {
    "coalesced": "SELECT coalesce(Phone, SSN) AS contact, AddressLine2 FROM customers",
    "chosen": "SELECT CASE WHEN Id > 5 THEN Email ELSE SSN END AS pick FROM customers",
}


def _classified_cells(spark, d, cases):
    """Classify each case's output columns, then count classified non-NULL cells over its full result."""
    register_views(_tables(spark, d))
    out = None
    for name, sql in cases.items():
        df = spark.sql(sql)
        types = classify_output(df, tables=set(CONTRACT_TABLES))
        if types is None:
            types = {c: "UNKNOWN" for c in df.columns}
        for col, ent in types.items():
            part = df.agg(F.count(F.col(f"`{col}`")).alias("cells")).select(
                F.lit(name).alias("case"), F.lit(col).alias("column"), F.lit(ent).alias("entity"), "cells")
            out = part if out is None else out.unionByName(part)
    return out


def _lineage_sql(expected: list[tuple[str, str, str, str]]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{case}' AS \"case\", '{col}' AS \"column\", '{ent}' AS entity, ({count}) AS cells"
                               for case, col, ent, count in expected)


@query("lineage_classify", _lineage_sql([
    ("renamed", "given", "PERSON", "SELECT count(FirstName) FROM customers"),
    ("renamed", "Zip", "ZIP", "SELECT count(Zip) FROM customers"),
    ("expression", "prefix", "PHONE", "SELECT count(Phone) FROM customers"),
    ("expression", "n", "EMAIL", "SELECT count(Email) FROM customers"),
    ("nested", "latest", "PHONE", "SELECT count(*) FROM (SELECT max(p) AS m FROM (SELECT reverse(Phone) AS p FROM customers) z WHERE p LIKE '%1%') y WHERE m IS NOT NULL"),
    ("with_join", "who", "PERSON", "SELECT count(LastName) FROM customers"),
    ("shadowed_name", "e", "SSN", "SELECT count(SSN) FROM customers"),
    ("unpivoted", "v", "SSN", "SELECT count(SSN) + count(Email) FROM customers"),
    ("rolled_up", "mail", "EMAIL", "SELECT count(DISTINCT Email) FROM customers"),
    ("united", "x", "SSN", "SELECT count(SSN) + count(Email) FROM customers"),
    ("scalar_subquery", "top", "SSN", "SELECT count(*) FROM contracts WHERE EXISTS (SELECT 1 FROM customers WHERE SSN IS NOT NULL)")]))
def q_lineage_classify(spark, d):
    return _classified_cells(spark, d, LINEAGE_CASES)


@query("lineage_restricted_wins", _lineage_sql([
    ("coalesced", "contact", "SSN", "SELECT count(coalesce(Phone, SSN)) FROM customers"),
    ("coalesced", "AddressLine2", "ADDRESS", "SELECT count(AddressLine2) FROM customers"),
    ("chosen", "pick", "SSN", "SELECT count(CASE WHEN Id > 5 THEN Email ELSE SSN END) FROM customers")]))
def q_lineage_restricted_wins(spark, d):
    return _classified_cells(spark, d, RESTRICTED_CASES)


CONTACT_SQL = """SELECT cs.contract_id, cs.FirstName || ' ' || cs.LastName AS CustomerName, cs.Email, cs.Phone,
  cs.AddressLine1, cs.Zip, cs.CustomerType FROM scoped_customers cs"""


def _contact_sheet(spark, tables):
    scoped = SC.contract_scope({n: tables[n] for n in CONTRACT_TABLES})
    scoped["customers"].createOrReplaceTempView("scoped_customers")
    df = spark.sql(CONTACT_SQL)
    policy = replace(DEFAULT, columns={("scoped_customers", c): e for (t, c), e in DEFAULT.columns.items() if t == "customers"})
    return df, classify_output(df, policy) or {}


@query("mask_rows", None)
def q_mask_rows(spark, d):
    """M3: the contact sheet of every contract, classified cells tokenized per contract session."""
    df, types = _contact_sheet(spark, _tables(spark, d))
    m = M.mask_rows(df.withColumn("session_id", F.col("contract_id")), types, ["contract_id"])
    return m.cells.drop("session_id", "pii_counts")


_SHEET_CTES = [
    ("cs", _SCOPE_SQL["customers"]),
    ("sheet", "SELECT contract_id, FirstName || ' ' || LastName AS CustomerName, Email, Phone, AddressLine1, Zip, "
              "CustomerType FROM cs"),
]
_MASKED_SHEET = """SELECT contract_id,
  CASE WHEN CustomerName IS NULL THEN NULL ELSE '<PERSON_1>' END AS CustomerName,
  CASE WHEN Email IS NULL THEN NULL ELSE '<EMAIL_1>' END AS Email,
  CASE WHEN Phone IS NULL THEN NULL ELSE '<PHONE_1>' END AS Phone,
  CASE WHEN AddressLine1 IS NULL THEN NULL ELSE '<ADDRESS_1>' END AS AddressLine1,
  CASE WHEN Zip IS NULL THEN NULL ELSE '<ZIP_1>' END AS Zip, CustomerType FROM sheet"""
# one customer row per contract session, so every classified value is the first of its type: <TYPE_1>
REGISTRY["mask_rows"] = (q_mask_rows, with_views(_MASKED_SHEET, *_SHEET_CTES))


@query("governed_contact_report", None)
def q_governed_contact_report(spark, d):
    return _contact_report(spark, _tables(spark, d))


def _contact_report(spark, tables):
    """Scoped -> classified -> masked -> rendered -> unmasked, per contract of the tables; the LLM-facing text holds
    tokens only, the user-facing text real values (SSN never selected)."""
    df, types = _contact_sheet(spark, tables)
    m = M.mask_rows(df.withColumn("session_id", F.col("contract_id")), types, ["contract_id"])
    rendered = m.cells.select(
        "contract_id", "session_id",
        F.concat_ws(" | ", *[F.coalesce(F.col(c), F.lit("-")) for c in ("CustomerName", "Email", "Phone",
                                                                         "AddressLine1", "Zip")]).alias("answer"))
    out = M.unmask(rendered, "answer", ["contract_id"], m.vault)
    return out.select("contract_id", F.col("answer").alias("masked_answer"), F.col("unmasked").alias("user_answer"))


REGISTRY["governed_contact_report"] = (q_governed_contact_report, with_views(
    "SELECT m.contract_id, " + " || ' | ' || ".join(f"coalesce(m.{c}, '-')" for c in
                                                     ("CustomerName", "Email", "Phone", "AddressLine1", "Zip"))
    + " AS masked_answer, " + " || ' | ' || ".join(f"coalesce(s.{c}, '-')" for c in
                                                    ("CustomerName", "Email", "Phone", "AddressLine1", "Zip"))
    + " AS user_answer FROM masked m JOIN sheet s ON s.contract_id = m.contract_id",
    *_SHEET_CTES, ("masked", _MASKED_SHEET)))


# --- P9 / R3: ad-hoc governed queries -------------------------------------------------------------
ADHOC_CASES = {  # name -> (SQL text, parameters)
    "people_of_kind": ("SELECT contract_id, FirstName, LastName, Email FROM customers WHERE CustomerType = :kind", {"kind": "Business"}),
    "owed_by_contract": ("SELECT r.EntityId AS contract, count(*) AS n, sum(rd.Balance) AS owed FROM receivables r "
                         "JOIN receivabledetails rd ON rd.ReceivableId = r.Id WHERE r.DueDate <= :as_of_date GROUP BY r.EntityId",
                         {"as_of_date": date(1995, 6, 30), "contract_id": 7}),
    "reachable": ("WITH c AS (SELECT concat_ws(' ', Zip, AddressLine1) AS place, upper(Phone) AS line FROM customers WHERE contract_id < :top) "
                  "SELECT line, place, count(*) AS n FROM c GROUP BY line, place", {"top": 3000}),
    "restricted_column": ("SELECT SSN FROM customers", {}),
    "not_published": ("SELECT FirstName FROM customers_all", {}),
    "script": ("SELECT TRANSFORM(Email) USING 'cat' AS (x) FROM customers", {}),
    "command": ("DROP VIEW customers", {}),
    "no_value": ("SELECT Id FROM contracts WHERE Id = :contract_id", {}),
    "reflection": ("SELECT reflect('java.lang.System', 'getProperty', 'user.name') AS who FROM contracts", {}),
    "text_for_a_value": ("SELECT Id FROM contracts WHERE SequenceNumber = :seq", {"seq": "x' OR '1'='1"}),
}


def _adhoc_rows(spark, d, name):
    sql, args = ADHOC_CASES[name]
    got = AD.governed_query(_tables(spark, d), sql, args, session=name)
    if got.rows is None:
        return spark.range(1).select(F.lit(name).alias("query"), F.lit(got.verdict).alias("verdict"), F.lit(got.reason).alias("reason"),
                                     F.lit(None).cast("string").alias("row"))
    cells = [F.col(c).cast("string").alias(c) for c in got.rows.columns if c not in (AD.SESSION, "pii_counts")]
    return got.rows.select(F.lit(name).alias("query"), F.lit(got.verdict).alias("verdict"), F.lit(None).cast("string").alias("reason"),
                           F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("row"))


@query("adhoc_governed", None)
def q_adhoc_governed(spark, d):
    """P9 + R3: SQL texts with parameters over the scoped views, each with its verdict and its masked rows."""
    return reduce(DataFrame.unionByName, [_adhoc_rows(spark, d, name) for name in ADHOC_CASES])


def _sql_tokenized(name: str, rows: str, columns: list[str], entities: dict[str, str]) -> tuple[list[tuple[str, str]], str]:
    """CTEs and SELECT of a query's rows with the values of ``entities`` columns numbered by first appearance, rows in
    the order of all their values and columns in theirs."""
    order = ", ".join(f"{c} NULLS FIRST" for c in columns)
    cells = " UNION ALL ".join(f"SELECT rn, {columns.index(c)} AS i, '{e}' AS entity, CAST({c} AS VARCHAR) AS v FROM {name}_r WHERE {c} IS NOT NULL"
                               for c, e in entities.items())
    norm = "lower(trim(regexp_replace(v, '\\s+', ' ', 'g')))"
    ctes = [(f"{name}_r", f"SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM ({rows}) z"),
            (f"{name}_c", f"SELECT *, {norm} AS norm FROM ({cells}) z"),
            (f"{name}_t", f"SELECT entity, norm, '<' || entity || '_' || row_number() OVER (PARTITION BY entity ORDER BY rn, i) || '>' AS token FROM ("
                          f"SELECT entity, norm, min(rn * 100 + i) // 100 AS rn, min(rn * 100 + i) % 100 AS i FROM {name}_c GROUP BY entity, norm) z")]
    fields = ", ".join(f"'{c}': (SELECT token FROM {name}_t t JOIN {name}_c x ON x.entity = t.entity AND x.norm = t.norm "
                       f"WHERE x.rn = r.rn AND x.i = {columns.index(c)})" if c in entities else f"'{c}': CAST({c} AS VARCHAR)" for c in columns)
    return ctes, f"SELECT '{name}' AS query, 'answered' AS verdict, CAST(NULL AS VARCHAR) AS reason, CAST(to_json({{{fields}}}) AS VARCHAR) AS \"row\" FROM {name}_r r"


def _adhoc_sql() -> str:
    ctes, parts = [("cs", _SCOPE_SQL["customers"])], []
    for name, rows, columns, entities in (
            ("people_of_kind", "SELECT contract_id, FirstName, LastName, Email FROM cs WHERE CustomerType = 'Business'",
             ["contract_id", "FirstName", "LastName", "Email"], {"FirstName": "PERSON", "LastName": "PERSON", "Email": "EMAIL"}),
            ("owed_by_contract", "SELECT r.EntityId AS contract, count(*) AS n, CAST(sum(rd.Balance) AS DECIMAL(28,2)) AS owed FROM receivables r "
             "JOIN receivabledetails rd ON rd.ReceivableId = r.Id WHERE r.EntityType = 'CT' AND r.DueDate <= DATE '1995-06-30' GROUP BY r.EntityId",
             ["contract", "n", "owed"], {}),
            ("reachable", "SELECT upper(Phone) AS line, Zip || ' ' || AddressLine1 AS place, count(*) AS n FROM cs WHERE contract_id < 3000 GROUP BY ALL",
             ["line", "place", "n"], {"line": "PHONE", "place": "ADDRESS"})):
        if entities:
            more, select = _sql_tokenized(name, rows, columns, entities)
            ctes += more
        else:
            fields = ", ".join(f"'{c}': CAST({c} AS VARCHAR)" for c in columns)
            select = f"SELECT '{name}', 'answered', CAST(NULL AS VARCHAR), CAST(to_json({{{fields}}}) AS VARCHAR) FROM ({rows}) r"
        parts.append(select)
    refused = {"restricted_column": AD.NOT_RESOLVED, "not_published": AD.NOT_RESOLVED, "script": AD.UNTRACEABLE, "command": AD.COMMAND,
               "no_value": AD.NOT_RESOLVED, "reflection": AD.FOREIGN_CODE}
    parts += [f"SELECT '{name}', 'refused', '{reason}', CAST(NULL AS VARCHAR)" for name, reason in refused.items()]
    return with_views("\nUNION ALL ".join(parts), *ctes)


REGISTRY["adhoc_governed"] = (q_adhoc_governed, _adhoc_sql())


@query("audit_adhoc", None)
def q_audit_adhoc(spark, d):
    """L1 of ad-hoc queries: each run with its SQL, outcome, counts and columns, as measured while its rows were written."""
    from ledgerguard.session import scratch_path
    runs = AD.run_governed(_tables(spark, d), ADHOC_CASES, scratch_path(spark, "adhoc"))
    columns = F.array_join(F.array_sort(F.transform(F.map_entries("pii_columns"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return runs.select("query", "sql", "outcome", F.array_join("sql_errors", ",").alias("sql_errors"), "row_count", columns.alias("pii_columns"),
                       A.counts_text(F.col("pii_masked_output")).alias("pii_masked_output"), (F.col("latency_ms") >= 0).alias("timed"))


def _audit_adhoc_sql() -> str:
    kind = "SELECT * FROM cs WHERE CustomerType = 'Business'"
    reach = "SELECT upper(Phone) AS line, Zip || ' ' || AddressLine1 AS place FROM cs WHERE contract_id < 3000 GROUP BY ALL"
    owed = "SELECT r.EntityId FROM receivables r JOIN receivabledetails rd ON rd.ReceivableId = r.Id WHERE r.EntityType = 'CT' AND r.DueDate <= DATE '1995-06-30' GROUP BY r.EntityId"
    answered = {
        "people_of_kind": (kind, "Email=EMAIL,FirstName=PERSON,LastName=PERSON",
                           f"(SELECT 'EMAIL=' || count(Email) || ',PERSON=' || (count(FirstName) + count(LastName)) FROM ({kind}) x)"),
        "owed_by_contract": (owed, "", "''"),
        "reachable": (reach, "line=PHONE,place=ADDRESS", f"(SELECT 'ADDRESS=' || count(place) || ',PHONE=' || count(line) FROM ({reach}) x)"),
        "text_for_a_value": ("SELECT 1 WHERE FALSE", "", "''")}
    refused = {"restricted_column": AD.NOT_RESOLVED, "not_published": AD.NOT_RESOLVED, "script": AD.UNTRACEABLE, "command": AD.COMMAND,
               "no_value": AD.NOT_RESOLVED, "reflection": AD.FOREIGN_CODE}
    quoted = {n: "'" + sql.replace("'", "''") + "'" for n, (sql, _) in ADHOC_CASES.items()}
    parts = [f"SELECT '{n}' AS query, {quoted[n]} AS sql, 'answered' AS outcome, '' AS sql_errors, (SELECT count(*) FROM ({rows}) x) AS row_count, "
             f"'{cols}' AS pii_columns, {counts} AS pii_masked_output, TRUE AS timed" for n, (rows, cols, counts) in answered.items()]
    parts += [f"SELECT '{n}', {quoted[n]}, 'refused', '{reason}', 0, '', '', TRUE" for n, reason in refused.items()]
    return with_views("\nUNION ALL ".join(parts), ("cs", _SCOPE_SQL["customers"]))


REGISTRY["audit_adhoc"] = (q_audit_adhoc, _audit_adhoc_sql())


# --- W3 / W4 on conversations --------------------------------------------------------------------
def _turns(spark, d):
    return A.conversation_turns(T(spark, d)["conversations"])


@query("turn_number", """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_number
FROM conversations WHERE role = 'user'""")
def q_turn_number(spark, d):
    return _turns(spark, d).select("conv_id", "turn", "turn_number")


# turns of a conversation, the user's with the note of the contract behind them; its customer's values are known
TURNS_SRC = """(SELECT conv_id * 100000 + turn AS id, conv_id AS session_id, CustomerId AS customer_id,
  CASE WHEN role = 'user' AND note IS NOT NULL THEN text || ' | ' || note ELSE text END AS t
  FROM conversations LEFT JOIN contract_notes ON ContractId = conv_id)"""
TURN_CTES = [("kv", CP.KV_SQL), *CP.sql_chosen(TURNS_SRC, True, "customer_id"), ("masked_turns", CP.sql_masked(TURNS_SRC)), ("said", """
  SELECT c.conv_id, c.turn, c.role, CASE WHEN c.text IS NOT NULL OR c.role = 'user' THEN m.masked END AS text, m.masked AS sent
  FROM conversations c JOIN masked_turns m ON m.id = c.conv_id * 100000 + c.turn"""), ("pairs", """
  SELECT u.conv_id, u.turn, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) AS turn_number, u.text AS question, a.text AS answer
  FROM said u LEFT JOIN said a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")]


@query("history_last3", None)
def q_history_last3(spark, d):
    """W3 + M7: the last three questions and answers of each turn, masked over the whole conversation."""
    cells = A.masked_conversations(T(spark, d)).cells
    said = cells.select("conv_id", "turn", "role", F.when(F.col("text").isNotNull() | (F.col("role") == "user"), F.col("masked")).alias("text"))
    return A.history_last(A.conversation_turns(said).select("conv_id", "turn_number", "question", "answer"), 3)


REGISTRY["history_last3"] = (q_history_last3, with_views("""
SELECT p.conv_id, p.turn_number,
  h1.question AS prev1_question, h1.answer AS prev1_answer, h2.question AS prev2_question, h2.answer AS prev2_answer,
  h3.question AS prev3_question, h3.answer AS prev3_answer
FROM pairs p
LEFT JOIN pairs h1 ON h1.conv_id = p.conv_id AND h1.turn_number = p.turn_number - 1
LEFT JOIN pairs h2 ON h2.conv_id = p.conv_id AND h2.turn_number = p.turn_number - 2
LEFT JOIN pairs h3 ON h3.conv_id = p.conv_id AND h3.turn_number = p.turn_number - 3""", *TURN_CTES))


# --- L1-L4, S4 -----------------------------------------------------------------------------------
_COUNTS = """SELECT id, string_agg(entity || '=' || n, ',' ORDER BY entity) AS counts FROM (SELECT id, entity, count(*) AS n FROM chosen GROUP BY id, entity) z GROUP BY id"""
_AUDIT_CTES = [*TURN_CTES, ("counts", _COUNTS), ("asked", "SELECT request_id, intent, outcome AS o, row_count FROM (" + ANSWERS_SQL + ") z"), ("records", """
  SELECT strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p.conv_id * 86400 + p.turn * 25 * 60 * (1 + p.conv_id % 4)), '%Y-%m-%dT%H:%M:%S.000Z') AS ts,
    p.conv_id AS session_id, p.turn_number AS turn, 'CT-' || p.conv_id AS sequence_number, p.question, p.answer,
    CASE WHEN o IS NULL OR o = 'not_found' THEN 'error' WHEN o = 'gave_up' OR p.answer IS NULL THEN 'gave_up' ELSE 'answered' END AS outcome, intent,
    CAST(NULL AS VARCHAR) AS sql, CAST(CASE WHEN o = 'gave_up' THEN 1 ELSE 0 END AS INTEGER) AS sql_attempts,
    CASE WHEN o = 'gave_up' THEN 'no generator' ELSE '' END AS sql_errors, coalesce(row_count, 0) AS row_count,
    coalesce(q.counts, '') AS pii_input, coalesce(a.counts, '') AS pii_masked_output, '' AS pii_guard_masked,
    'classify_intent' || CASE WHEN intent = 'adhoc' THEN ',generate_sql' ELSE '' END || CASE WHEN p.answer IS NOT NULL THEN ',compose_answer' ELSE '' END AS llm_calls
  FROM pairs p LEFT JOIN asked ON request_id = p.conv_id LEFT JOIN counts q ON q.id = p.conv_id * 100000 + p.turn
  LEFT JOIN counts a ON p.answer IS NOT NULL AND a.id = p.conv_id * 100000 + p.turn + 1""")]
_ROLLUP_SQL = """
SELECT substr(r.ts, 1, 10) AS day, r.session_id, count(*) AS turns, sum((outcome = 'answered')::INT)::BIGINT AS answered, sum((outcome = 'gave_up')::INT)::BIGINT AS gave_up,
  sum((outcome = 'error')::INT)::BIGINT AS error, sum(sql_attempts)::BIGINT AS attempts, coalesce(any_value(t.pii_input), '') AS pii_input
FROM records r LEFT JOIN (
  SELECT day, session_id, string_agg(entity || '=' || n, ',' ORDER BY entity) AS pii_input FROM (
    SELECT day, session_id, split_part(x, '=', 1) AS entity, sum(CAST(split_part(x, '=', 2) AS BIGINT))::BIGINT AS n FROM (
      SELECT substr(ts, 1, 10) AS day, session_id, unnest(string_split(pii_input, ',')) AS x FROM records WHERE pii_input <> '') z GROUP BY ALL) y
  GROUP BY ALL) t ON t.day = substr(r.ts, 1, 10) AND t.session_id = r.session_id
GROUP BY substr(r.ts, 1, 10), r.session_id"""


@query("audit_records", None)
def q_audit_records(spark, d):
    """L1, maps and calls as text."""
    return A.flat_records(A.audit_records(spark, T(spark, d)))


REGISTRY["audit_records"] = (q_audit_records, with_views("SELECT * FROM records", *_AUDIT_CTES))

# A masking that misses phone numbers and known values, so that the guard has something to find
MISSES_PHONES = replace(DEFAULT, detectors=replace(DEFAULT.detectors, regex=("SSN", "CREDIT_CARD", "EMAIL"), known_values=False))
REGEX_GUARD = replace(DEFAULT, detectors=replace(DEFAULT.detectors, known_values=False))


@query("audit_guard_totals", None)
def q_audit_guard_totals(spark, d):
    """L2 with a planted miss: what the guard finds after a masking without the phone detector."""
    return A.guard_totals(A.audit_records(spark, T(spark, d), MISSES_PHONES, REGEX_GUARD))


_MISSED_SRC = "(SELECT id, id // 100000 AS session_id, masked AS t FROM masked_turns)"
REGISTRY["audit_guard_totals"] = (q_audit_guard_totals, with_views(
    """SELECT p.conv_id AS session_id, p.turn_number AS turn, 'PHONE' AS entity,
  CAST(sum(f.n * CASE WHEN f.id % 100000 = p.turn THEN 1 + coalesce((SELECT max((intent = 'adhoc')::INT) FROM requests WHERE request_id = p.conv_id), 0) ELSE 1 END) AS BIGINT) AS n
FROM (SELECT u.conv_id, u.turn, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) AS turn_number, a.turn AS answered
      FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND a.text IS NOT NULL WHERE u.role = 'user') p
JOIN found f ON f.id IN (p.conv_id * 100000 + p.turn, p.conv_id * 100000 + p.answered) GROUP BY ALL""",
    *CP.sql_chosen(TURNS_SRC, False, entities=("SSN", "CREDIT_CARD", "EMAIL")), ("masked_turns", CP.sql_masked(TURNS_SRC)),
    ("found", f"SELECT id, count(*) AS n FROM ({CP.sql_regex_spans(_MISSED_SRC, 'id, session_id', 'PHONE')}) z GROUP BY id")))


@query("audit_calls", None)
def q_audit_calls(spark, d):
    return A.call_metadata(A.audit_records(spark, T(spark, d)))


REGISTRY["audit_calls"] = (q_audit_calls, with_views("""
SELECT session_id, turn, node, CAST(length(payload) AS INTEGER) AS chars, substr(sha256(payload), 1, 16) AS sha256, CAST(0 AS INTEGER) AS guard_types, FALSE AS payload_kept
FROM (SELECT session_id, turn, unnest(string_split(llm_calls, ',')) AS node, question, answer FROM records) r,
  LATERAL (SELECT CASE WHEN node = 'compose_answer' THEN answer ELSE question END AS payload)""", *_AUDIT_CTES))


@query("sink_audit_json", None)
def q_sink_audit_json(spark, d):
    """S4 + L4: write the audit records as JSON lines (append) to the shared folder, read them back and roll up."""
    from ledgerguard.session import scratch_path
    path = scratch_path(spark, "audit")
    A.write_audit(A.audit_records(spark, T(spark, d)), path, run="1")
    return A.audit_rollup(spark.read.schema(A.AUDIT_READ_SCHEMA).json(path))


@query("audit_rollup", None)
def q_audit_rollup(spark, d):
    return A.audit_rollup(A.audit_records(spark, T(spark, d)))


REGISTRY["sink_audit_json"] = (q_sink_audit_json, with_views(_ROLLUP_SQL, *_AUDIT_CTES))
REGISTRY["audit_rollup"] = (q_audit_rollup, REGISTRY["sink_audit_json"][1])


@query("leak_scan_outgoing", None)
def q_leak_scan_outgoing(spark, d):
    """G3 over what leaves: no value of any customer (names, postcodes and all) in the audit records or in the masked side of the
    governed report. The raw notes go through the same scan as a control that must show what masking took away."""
    t = T(spark, d)
    audit = A.audit_records(spark, t)
    report = q_governed_contact_report(spark, d)
    texts = (audit.select(F.lit("audit").alias("source"), F.col("session_id").alias("id"), F.concat_ws(" | ", "question", "answer").alias("text"))
             .unionByName(report.select(F.lit("report").alias("source"), F.col("contract_id").alias("id"), F.col("masked_answer").alias("text")))
             .unionByName(t["contract_notes"].select(F.lit("control").alias("source"), F.col("ContractId").alias("id"), F.col("note").alias("text"))))
    return M.leak_scan(texts, "text", ["source", "id"], CP._leak_values(spark, d)).distinct()


REGISTRY["leak_scan_outgoing"] = (q_leak_scan_outgoing, with_views(
    "SELECT 'control' AS source, ContractId AS id, entity, value FROM (SELECT DISTINCT ContractId, entity, canon AS value FROM ("
    + CP.sql_literal_offsets("src", "ContractId, entity, canon") + ") o) l", *CP._LEAK_CTES))


# --- E2 ----------------------------------------------------------------------------------------
@query("answer_scoring", None)
def q_answer_scoring(spark, d):
    """E2 over the answers to all requests and, as the group ``pii``, the governed contact reports. Ad-hoc questions of known
    contracts fail: there is no SQL generator here. All of it is done for the contracts that are asked about."""
    t = E.requested_tables(T(spark, d))
    contacts = SC.contract_scope({n: t[n] for n in CONTRACT_TABLES})["customers"].select("contract_id", "Email", "Phone")
    cases, answers = E.contact_cases(t, contacts, _contact_report(spark, t))
    given = K.answer_requests(t["requests"], t).select("request_id", "intent", "outcome", "rows_json")
    return E.answer_scoring(E.eval_cases(t).unionByName(cases), given.unionByName(answers))


REGISTRY["answer_scoring"] = (q_answer_scoring, with_views("""
SELECT "group", count(*) AS cases, CAST(sum(passed) AS BIGINT) AS passed, sum(passed)::DOUBLE / count(*) AS pass_rate, any_value(threshold) AS threshold,
  sum(passed)::DOUBLE / count(*) >= any_value(threshold) AS accepted
FROM (SELECT CASE WHEN r.intent = 'adhoc' THEN 'adhoc' ELSE 'core' END AS "group", CASE WHEN r.intent = 'adhoc' AND c.Id IS NOT NULL THEN 0 ELSE 1 END AS passed,
             CASE WHEN r.intent = 'adhoc' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS threshold
      FROM requests r LEFT JOIN contracts c ON c.SequenceNumber = trim(r.seq)
      UNION ALL SELECT 'pii', 1, 0.75::DOUBLE FROM requests r JOIN contracts c ON c.SequenceNumber = trim(r.seq)) z
GROUP BY ALL"""))


# --- S3, S5, S6 ---------------------------------------------------------------------------------
@query("src_policy_columns", None)
def q_src_policy_columns(spark, d):
    """S3: policy column classification as a table, with the number of non-NULL values each classified
    customer column holds."""
    from ledgerguard.sources.policy import policy_columns
    cu = T(spark, d)["customers"]
    pol = policy_columns(spark)
    counts = cu.select(F.explode(F.array(*[F.struct(F.lit(c.lower()).alias("column"),
                                                    F.col(c).isNotNull().cast("long").alias("v"))
                                           for c in cu.columns])).alias("x")) \
        .groupBy("x.column").agg(F.sum("x.v").alias("non_null_values"))
    return pol.join(counts, "column", "left")


REGISTRY["src_policy_columns"] = (q_src_policy_columns, with_views(
    "SELECT p.table_name, p.column, p.entity, p.revealed, p.restricted, c.non_null_values FROM (VALUES "
    + ", ".join(f"('{t}', '{c}', '{e}', {str(P.ENTITY_TYPES[e]).upper()}, {str((t, c) in P.RESTRICTED_COLUMNS).upper()})"
                for (t, c), e in P.CLASSIFIED_COLUMNS.items())
    + ") p(table_name, \"column\", entity, revealed, restricted) LEFT JOIN (SELECT 'firstname' AS \"column\", COUNT(FirstName) AS non_null_values FROM customers "
    + " ".join(f"UNION ALL SELECT '{c.lower()}', COUNT({c}) FROM customers" for c in
               ("LastName", "Email", "Phone", "AddressLine1", "AddressLine2", "Zip", "SSN"))
    + ") c ON c.\"column\" = p.\"column\""))


@query("sink_json_rows", None)
def q_sink_json_rows(spark, d):
    """Portfolio rows as JSON (decimals as text, dates ISO, NULLs kept)."""
    rep = K.portfolio_report(T(spark, d), ordered=False)
    return rep.select("SequenceNumber", X.json_row(rep.columns, dict(rep.dtypes)).alias("json"))


REGISTRY["sink_json_rows"] = (q_sink_json_rows, with_views(
    "SELECT SequenceNumber, to_json({" + ", ".join(
        f"'{c}': {'CAST(' + c + ' AS VARCHAR)' if c in ('NextDueDate', 'NextDueTotal', 'InvoiceAmount', 'InvoiceTaxAmount', 'OutstandingTotal') else c}"
        for c in ("SequenceNumber", "ContractType", "Status", "WorkflowStatus", "NextDueDate", "NextDueTotal",
                  "InvoiceCount", "InvoiceAmount", "InvoiceTaxAmount", "OutstandingTotal"))
    + "}) AS json FROM (" + __import__("ledgerguard.plans.catalog", fromlist=["PORTFOLIO_SQL"]).PORTFOLIO_SQL + ") r"))


@query("row_cap", f"""
SELECT ContractId, DueDate, Balance, row_number, n > 200 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY ContractId ORDER BY DueDate) AS row_number,
         COUNT(*) OVER (PARTITION BY ContractId) AS n FROM (
    SELECT r.EntityId AS ContractId, r.DueDate, CAST(SUM(rd.Balance) AS DECIMAL(18,2)) AS Balance
    FROM receivables r JOIN receivabledetails rd ON rd.ReceivableId = r.Id
    WHERE r.EntityType = 'CT' AND r.IsActive AND r.DueDate <= DATE '1998-10-01'
      AND rd.BillingStatus NOT IN ('Paid', 'Suppressed', 'Suspended') AND rd.Balance > 0
    GROUP BY r.EntityId, r.DueDate) o) x WHERE row_number <= 200""")
def q_row_cap(spark, d):
    """Overdue receivables capped at 200 rows per contract (earliest due first), with a truncation flag."""
    t = T(spark, d)
    return X.cap_rows(K.overdue_receivables(t["receivables"], t["receivabledetails"], ordered=False), ["ContractId"], ["DueDate"], n=200)


# --- F1, F2, F3, F5, F7 ---------------------------------------------------------------------------
@query("fn_normalize", """
SELECT conv_id, turn, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') AS norm FROM conversations""")  # (full folding; ß is the one letter here that folds otherwise)
def q_fn_normalize(spark, d):
    c = T(spark, d)["conversations"]
    return c.select("conv_id", "turn", S.normalize_value(F.col("text")).alias("norm"))


@query("fn_full_name", "SELECT Id, FirstName || ' ' || LastName AS FullName FROM customers")
def q_fn_full_name(spark, d):
    cu = T(spark, d)["customers"]
    return cu.select("Id", X.full_name(F.col("FirstName"), F.col("LastName")).alias("FullName"))


@query("fn_upper_phone", "SELECT Id, upper(Phone) AS p, TRY_CAST(FirstName AS INTEGER) AS n FROM customers")
def q_fn_upper_phone(spark, d):
    cu = T(spark, d)["customers"]
    return cu.select("Id", F.upper("Phone").alias("p"), F.col("FirstName").try_cast("int").alias("n"))


@query("fn_payload_sha", "SELECT conv_id, turn, length(text) AS chars, substr(sha256(text), 1, 16) AS sha256 FROM conversations")
def q_fn_payload_sha(spark, d):
    c = T(spark, d)["conversations"]
    return c.select("conv_id", "turn", *X.payload_digest(F.col("text")))


@query("fn_money", """
SELECT SequenceNumber, format('{:,.2f}', OutstandingTotal) AS outstanding, strftime(NextDueDate, '%Y-%m-%d') AS next_due
FROM (""" + __import__("ledgerguard.plans.catalog", fromlist=["PORTFOLIO_SQL"]).PORTFOLIO_SQL + ") r")
def q_fn_money(spark, d):
    rep = K.portfolio_report(T(spark, d), ordered=False)
    return rep.select("SequenceNumber", X.money(F.col("OutstandingTotal")).alias("outstanding"),
                      F.date_format("NextDueDate", "yyyy-MM-dd").alias("next_due"))


@query("fn_rows_json", """
SELECT ContractId, row_number() OVER (PARTITION BY ContractId ORDER BY DueDate) AS row_number,
       '{"DueDate":"' || CAST(DueDate AS VARCHAR) || '","Balance":"' || Balance || '"}' AS row_json
FROM (SELECT r.EntityId AS ContractId, r.DueDate, CAST(SUM(rd.Balance) AS DECIMAL(18,2)) AS Balance
      FROM receivables r JOIN receivabledetails rd ON rd.ReceivableId = r.Id
      WHERE r.EntityType = 'CT' AND r.IsActive AND r.DueDate <= DATE '1998-10-01'
        AND rd.BillingStatus NOT IN ('Paid', 'Suppressed', 'Suspended') AND rd.Balance > 0
      GROUP BY r.EntityId, r.DueDate) o""")
def q_fn_rows_json(spark, d):
    """F8: each contract's overdue rows as JSON objects, in order."""
    t = T(spark, d)
    od = K.overdue_receivables(t["receivables"], t["receivabledetails"], ordered=False)
    return X.rows_json(od, ["ContractId"], ["DueDate", "Balance"])


# --- D6 -----------------------------------------------------------------------------------------
@query("detect_names", None)
def q_detect_names(spark, d):
    """D6 default plug-in: a name gazetteer (every customer's first and last name) joined against the notes'
    words; spans carry a score and are type-mapped and filtered by the minimum score."""
    from ledgerguard.operators.names import detect_names, gazetteer_from_customers
    t = T(spark, d)
    return detect_names(t["contract_notes"].select("ContractId", "note"), "note", ["ContractId"],
                        gazetteer_from_customers(t["customers"]))


REGISTRY["detect_names"] = (q_detect_names, with_views(
    "SELECT ContractId, CAST(\"start\" AS INTEGER) AS \"start\", CAST(\"end\" AS INTEGER) AS \"end\", value, entity, score FROM ("
    + CP.sql_literal_offsets("found", "ContractId, entity, score") + ") z",
    ("names", """SELECT name AS value, entity, score FROM (
      SELECT FirstName AS name, 'PERSON' AS entity, 0.85::DOUBLE AS score FROM customers UNION SELECT LastName, 'PERSON', 0.85::DOUBLE FROM customers
      UNION SELECT AddressLine1, 'ADDRESS', 0.7::DOUBLE FROM customers) n WHERE length(name) >= 3"""),
    ("words", "SELECT value, entity, score, unnest(list_distinct(string_split_regex(lower(value), '[^\\p{L}\\p{N}_]+'))) AS word FROM names"),
    ("texts", "SELECT DISTINCT ContractId, unnest(string_split_regex(lower(note), '[^\\p{L}\\p{N}_]+')) AS word FROM contract_notes"),
    ("found", "SELECT DISTINCT n.ContractId, n.note AS t, w.value, w.entity, w.score FROM words w JOIN texts x ON x.word = w.word AND w.word <> '' JOIN contract_notes n ON n.ContractId = x.ContractId")))

NAME_MODEL = replace(DEFAULT, detectors=replace(DEFAULT.detectors, name_model="name_tagger"))


@query("detect_names_model", None)
def q_detect_names_model(spark, d):
    """D6, the model slot: names that the policy's model finds in the notes and in what users say."""
    from ledgerguard.operators.name_model import detect_names_model
    t = T(spark, d)
    texts = (t["contract_notes"].select(F.lit("note").alias("kind"), F.col("ContractId").alias("id"), F.lit(0).cast("long").alias("turn"), F.col("note").alias("text"))
             .unionByName(t["conversations"].select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")))
    return detect_names_model(texts, "text", ["kind", "id", "turn"], NAME_MODEL)


@query("mask_names_model", None)
def q_mask_names_model(spark, d):
    """D6 in M4: the notes masked without known values, names by the model."""
    from ledgerguard.operators.name_model import add_model_spans
    notes = T(spark, d)["contract_notes"].select("ContractId", F.col("CustomerId").alias("session_id"), "note")
    tagged = add_model_spans(notes, "note", NAME_MODEL)
    return M.mask_text(tagged, "note", ["ContractId"], extra_spans_col="name_spans", policy=NAME_MODEL).cells.select("ContractId", "masked")


# --- F6, G4 ---------------------------------------------------------------------------------------
@query("fn_jsonable", """
SELECT ReceivableId, strftime(DueDate, '%Y-%m-%d') AS DueDate, CAST(Amount AS VARCHAR) AS Amount,
  CAST(Balance AS VARCHAR) AS Balance, BillingStatus FROM receivabledetails""")
def q_fn_jsonable(spark, d):
    """dates ISO, decimals as text, other values unchanged (the JSON-safe row form)."""
    rd = T(spark, d)["receivabledetails"]
    dt = dict(rd.dtypes)
    return rd.select("ReceivableId", *[X.jsonable(F.col(c), dt[c]).alias(c) for c in ("DueDate", "Amount", "Balance")],
                     "BillingStatus")


@query("visible_check", None)
def q_visible_check(spark, d):
    """After unmasking, the user sees every revealed value of the contact sheet and never the SSN."""
    rep = q_governed_contact_report(spark, d)
    cu = SC.contract_scope(_tables(spark, d))["customers"].select("contract_id", "Email", "Phone", "Zip")
    ssn = T(spark, d)["customers"].select(F.col("Id").alias("_cid"), "SSN")
    lf = T(spark, d)["leasefinances"].select(F.col("ContractId").alias("contract_id"), F.col("CustomerId").alias("_cid"))
    ln = T(spark, d)["loanfinances"].select(F.col("ContractId").alias("contract_id"), F.col("CustomerId").alias("_cid"))
    owner = lf.unionByName(ln).join(ssn, "_cid").select("contract_id", "SSN")
    j = rep.join(cu, "contract_id").join(owner, "contract_id", "left")
    required_ok = (F.col("user_answer").contains(F.col("Email")) & F.col("user_answer").contains(F.col("Phone"))
                   & F.col("user_answer").contains(F.col("Zip")))
    restricted_absent = F.coalesce(~F.col("user_answer").contains(F.col("SSN")), F.lit(True))
    masked_clean = ~F.col("masked_answer").contains(F.col("Email"))
    return j.select("contract_id", required_ok.alias("required_visible"), restricted_absent.alias("restricted_absent"),
                    masked_clean.alias("masked_clean"))


REGISTRY["visible_check"] = (q_visible_check, with_views(
    "SELECT contract_id, TRUE AS required_visible, TRUE AS restricted_absent, TRUE AS masked_clean FROM ("
    + _SCOPE_SQL["customers"] + ") s"))


# --- oracle for E1 ---------------------------------------------------------------------
from ledgerguard.plans.catalog import PORTFOLIO_SQL as _PORTFOLIO_SQL, _NEXT_DUE_SQL, _OUTSTANDING_SQL  # noqa: E402

_GOLDEN_FIELDS = ("Status", "NextDueDate", "NextDueTotal", "InvoiceCount", "InvoiceAmount", "OutstandingTotal")
_GOLDEN_CTES = [("rep", _PORTFOLIO_SQL.replace("ORDER BY c.SequenceNumber", "")), ("inv", """SELECT lf.ContractId, SUM(x.InvoiceCount) AS InvoiceCount,
               CASE WHEN COUNT(*) = 1 THEN MAX(x.InvoiceAmount) END AS InvoiceAmount
        FROM (SELECT lf.ContractId, pi.Currency, COUNT(pi.Id) AS InvoiceCount,
                     CAST(SUM(pi.InvoiceAmount) AS DECIMAL(18,2)) AS InvoiceAmount
              FROM leasefinances lf JOIN leasefundings lfu ON lfu.LeaseFinanceId = lf.Id
              JOIN payableinvoices pi ON pi.Id = lfu.PayableInvoiceId GROUP BY lf.ContractId, pi.Currency) x
        JOIN leasefinances lf ON lf.ContractId = x.ContractId GROUP BY lf.ContractId"""), ("act", f"""
  SELECT c.SequenceNumber, COALESCE(c.Status, 'Not yet commenced') AS Status, nd.NextDueDate,
         CAST(nd.Amount + nd.TaxAmount AS DECIMAL(18,2)) AS NextDueTotal, COALESCE(inv.InvoiceCount, 0) AS InvoiceCount,
         inv.InvoiceAmount, CAST(COALESCE(os.OutstandingTotal, 0) AS DECIMAL(18,2)) AS OutstandingTotal
  FROM contracts c LEFT JOIN ({_NEXT_DUE_SQL}) nd ON nd.ContractId = c.Id
  LEFT JOIN inv ON inv.ContractId = c.Id LEFT JOIN ({_OUTSTANDING_SQL}) os ON os.ContractId = c.Id""")]
_GOLDEN_SQL = "SELECT SequenceNumber, Field, Expected, Actual FROM (\n" + "\nUNION ALL ".join(
    f"  SELECT COALESCE(a.SequenceNumber, r.SequenceNumber) AS SequenceNumber, '{f}' AS Field, "
    f"CAST(r.{f} AS VARCHAR) AS Expected, CAST(a.{f} AS VARCHAR) AS Actual, "
    f"(a.SequenceNumber IS NULL OR r.SequenceNumber IS NULL OR CAST(a.{f} AS VARCHAR) IS DISTINCT FROM CAST(r.{f} AS VARCHAR)) AS diff "
    f"FROM act a FULL OUTER JOIN rep r ON r.SequenceNumber = a.SequenceNumber" for f in _GOLDEN_FIELDS) + "\n) d WHERE diff"

REGISTRY["golden_diff"] = (REGISTRY["golden_diff"][0], with_views(_GOLDEN_SQL, *_GOLDEN_CTES))
