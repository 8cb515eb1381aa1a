"""PII queries: detection, known values, overlap resolution, tokens, masking, unmasking, guard, leak scan.

Inputs: ``documents.text`` (corpus; session = ``source``, row order = ``doc_id``) and the PII-dense
``contract_notes`` (session = the customer, row order = ``ContractId``, known values = that customer's
profile). The DuckDB oracles rewrite lookarounds as boundary groups (RE2) and compute offsets from
``regexp_extract_all`` groups and ``string_split_regex`` gaps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerguard.functions import patterns as P
from ledgerguard.functions import spans as S
from ledgerguard.operators import masking as M
from ledgerguard.operators import vault as V
from ledgerguard.plans.catalog import REGISTRY, T, query
from ledgerguard.plans.oracle_views import with_views
from ledgerguard.sources.policy import DEFAULT, from_mapping


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- oracle SQL builders ---------------------------------------------------------------------
def sql_offsets(src: str, cols: str, pattern: str) -> str:
    """Rows (cols, start, end, value) for every match of a 3-group RE2 pattern (group 2 = the match)."""
    return f"""
SELECT {cols}, CAST(coalesce(list_sum([length(gaps[k]) + length(g1[k]) + length(g2[k]) + length(g3[k])
                                     for k in range(1, i)]), 0) + length(gaps[i]) + length(g1[i]) AS INTEGER) AS "start",
       CAST(coalesce(list_sum([length(gaps[k]) + length(g1[k]) + length(g2[k]) + length(g3[k])
                                     for k in range(1, i)]), 0) + length(gaps[i]) + length(g1[i]) + length(g2[i]) AS INTEGER) AS "end",
       g2[i] AS value
FROM (SELECT {cols}, g1, g2, g3, gaps, unnest(range(1, len(g2) + 1)) AS i FROM (
  SELECT {cols}, regexp_extract_all(t, {pattern}, 1) AS g1, regexp_extract_all(t, {pattern}, 2) AS g2,
         regexp_extract_all(t, {pattern}, 3) AS g3, string_split_regex(t, {pattern}) AS gaps
  FROM {src}) a) b"""


def sql_offsets_2pass(src: str, cols: str, pattern: str) -> str:
    """``sql_offsets`` plus a second pass over the text with first-pass matches blanked to word characters:
    recovers a match whose leading boundary character was consumed as the previous match's trailing group
    (two numbers separated by one space)."""
    p1 = sql_offsets(src, cols, pattern)
    src2 = f"""(SELECT s.* EXCLUDE (t), CASE WHEN b.id IS NULL THEN s.t ELSE b.body || substr(s.t, b.last_end + 1) END AS t
FROM {src} s LEFT JOIN (
  SELECT p.id, string_agg(substr(x.t, p.prev + 1, p."start" - p.prev) || repeat('x', p."end" - p."start"), ''
                          ORDER BY p."start") AS body, max(p."end") AS last_end
  FROM (SELECT id, "start", "end", coalesce(lag("end") OVER (PARTITION BY id ORDER BY "start"), 0) AS prev
        FROM ({p1}) q) p
  JOIN {src} x ON x.id = p.id GROUP BY p.id) b ON b.id = s.id)"""
    return f"{p1}\nUNION ALL {sql_offsets(src2, cols, pattern)}"


def sql_luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    x = f"CAST(substr({d}, k, 1) AS INTEGER)"
    return (f"(coalesce(list_sum([CASE WHEN (length({d}) - k) % 2 = 0 THEN {x} "
            f"WHEN {x} * 2 > 9 THEN {x} * 2 - 9 ELSE {x} * 2 END for k in range(1, length({d}) + 1)]), 1) % 10 = 0)")


def sql_regex_spans(src: str, cols: str, entity: str) -> str:
    two_pass = entity in ("SSN", "CREDIT_CARD")
    base = (sql_offsets_2pass if two_pass else sql_offsets)(src, cols, _q(P.RE2[entity]))
    rank = P.entity_rank(entity, "regex")
    out = f"SELECT {cols}, \"start\", \"end\", value, '{entity}' AS entity, {rank} AS rank FROM ({base}) r"
    if entity == "CREDIT_CARD":
        out += f" WHERE {sql_luhn('value')}"
    return out


NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
DISP = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"

KV_SQL = """
SELECT session_id, norm, value, entity, col_idx FROM (
  SELECT session_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS value,
         lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS norm, entity, col_idx,
         row_number() OVER (PARTITION BY session_id, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) ORDER BY col_idx) AS rn
  FROM (
    SELECT Id AS session_id, FirstName AS raw, 'PERSON' AS entity, 0 AS col_idx FROM customers
    UNION ALL SELECT Id, LastName, 'PERSON', 1 FROM customers
    UNION ALL SELECT Id, AddressLine1, 'ADDRESS', 2 FROM customers
    UNION ALL SELECT Id, AddressLine2, 'ADDRESS', 3 FROM customers
    UNION ALL SELECT Id, Zip, 'ZIP', 4 FROM customers
    UNION ALL SELECT Id, Phone, 'PHONE', 5 FROM customers
    UNION ALL SELECT Id, Email, 'EMAIL', 6 FROM customers
    UNION ALL SELECT Id, CASE WHEN trim(FirstName) <> '' AND trim(LastName) <> '' THEN FirstName || ' ' || LastName END,
                     'PERSON', 7 FROM customers) u
  WHERE raw IS NOT NULL AND trim(regexp_replace(raw, '\\s+', ' ', 'g')) <> '') x
WHERE rn = 1"""

KNOWN_PATTERN_SQL = ("'(?i)(^|[^\\p{L}\\p{N}_])(' || array_to_string(list_transform(string_split(value, ' '), "
                     "lambda w: regexp_escape(w)), '\\s+') || ')($|[^\\p{L}\\p{N}_])'")

NOTES_SRC = "(SELECT ContractId AS id, CustomerId AS session_id, note AS t FROM contract_notes)"
DOCS_SRC = "(SELECT doc_id AS id, source AS session_id, text AS t FROM documents)"


WORD_RE2 = "'[\\p{L}\\p{N}_]'"


def sql_literal_offsets(src: str, cols: str) -> str:
    """Word-bounded, case-insensitive occurrences of a literal ``value`` in ``t`` (constant patterns only):
    ``string_split`` on the lower-cased literal gives the gaps, boundaries are checked per occurrence."""
    return f"""
SELECT {cols}, "start", "start" + length(value) AS "end", substr(t, "start" + 1, length(value)) AS value FROM (
  SELECT {cols}, t, value,
         CAST(list_sum([length(gaps[k]) for k in range(1, i + 1)]) + (i - 1) * length(value) AS INTEGER) AS "start"
  FROM (SELECT {cols}, t, value, gaps, unnest(range(1, len(gaps))) AS i FROM (
    SELECT {cols}, t, value, string_split(lower(t), lower(value)) AS gaps FROM {src}) a) b) c
WHERE ("start" = 0 OR NOT regexp_matches(substr(t, "start", 1), {WORD_RE2}))
  AND ("start" + length(value) = length(t) OR NOT regexp_matches(substr(t, "start" + length(value) + 1, 1), {WORD_RE2}))"""


def sql_known_spans(texts: str = NOTES_SRC, customer: str = "session_id") -> str:
    src = (f"(SELECT n.id, n.session_id, n.t, kv.value, kv.entity FROM {texts} n "
           f"JOIN kv ON kv.session_id = n.{customer} WHERE length(kv.value) >= {P.KNOWN_VALUE_MIN_LENGTH})")
    base = sql_literal_offsets(src, "id, session_id, entity")
    return f"SELECT id, session_id, \"start\", \"end\", value, entity, {P.entity_rank('PERSON', 'known')} AS rank FROM ({base}) k"


def sql_all_spans(src: str, with_known: bool, customer: str = "session_id", entities: tuple[str, ...] = P.REGEX_ENTITIES) -> str:
    parts = [sql_regex_spans(src, "id, session_id", e) for e in entities]
    if with_known:
        parts.append(sql_known_spans(src if customer != "session_id" else NOTES_SRC, customer))
    return "\nUNION ALL ".join(f"SELECT id, session_id, \"start\", \"end\", value, entity, rank FROM ({p}) q{i}"
                               for i, p in enumerate(parts))


ALLOW_SQL = ("(lower(trim(value)) IN (" + ", ".join(_q(t.lower()) for t in P.ALLOW_TERMS) + ") OR "
             + " OR ".join(f"regexp_full_match(trim(value), {_q(p)})" for p in P.ALLOW_PATTERNS) + ")")


def sql_chosen(src: str, with_known: bool, customer: str = "session_id", entities: tuple[str, ...] = P.REGEX_ENTITIES) -> list[tuple[str, str]]:
    """CTEs: raw spans -> possessive trim -> allow-list -> earliest/longest/rank non-overlap."""
    trim = ("CASE WHEN value LIKE '%''s' OR value LIKE '%’s' THEN \"end\" - 2 ELSE \"end\" END")
    return [
        ("sp_raw", sql_all_spans(src, with_known, customer, entities)),
        ("sp", f"SELECT id, session_id, \"start\", {trim} AS \"end\", "
               f"CASE WHEN value LIKE '%''s' OR value LIKE '%’s' THEN substr(value, 1, length(value) - 2) ELSE value END AS value, "
               f"entity, rank FROM sp_raw"),
        ("sp_ok", f"SELECT * FROM sp WHERE NOT {ALLOW_SQL}"),
        # greedy: from each chosen span on to the first one in order that starts at or after its end
        ("chosen", """SELECT * EXCLUDE (k) FROM (
  WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "start", "end" DESC, rank, entity) AS k FROM sp_ok),
  g AS (SELECT id, k, "end" AS e FROM o WHERE k = 1
        UNION ALL SELECT o.id, min(o.k), arg_min(o."end", o.k) FROM g JOIN o ON o.id = g.id AND o.k > g.k AND o."start" >= g.e GROUP BY o.id)
  SELECT o.* FROM o JOIN g ON g.id = o.id AND g.k = o.k) z"""),
        ("occ", f"SELECT *, {DISP.format('value')} AS disp, {NORM.format('value')} AS norm FROM chosen"),
        ("firsts", """SELECT session_id, entity, norm, disp AS value, id AS first_id, "start" AS first_start FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, entity, norm ORDER BY id, "start" DESC) AS rn FROM occ) f WHERE rn = 1"""),
        ("vault", """SELECT session_id, entity, norm, value,
  row_number() OVER (PARTITION BY session_id, entity ORDER BY first_id, first_start DESC) AS n FROM firsts"""),
        ("tk", """SELECT o.id, o."start", o."end", o.entity, '<' || o.entity || '_' || CAST(v.n AS VARCHAR) || '>' AS token,
  v.value AS vault_value FROM occ o JOIN vault v USING (session_id, entity, norm)"""),
    ]


def sql_masked(src: str, replacement: str = "token") -> str:
    """Rebuild every source text with its chosen spans replaced (``token`` or an expression over tk)."""
    return f"""
SELECT s.id, CASE WHEN b.id IS NULL THEN coalesce(s.t, '') ELSE b.body || substr(s.t, b.last_end + 1) END AS masked
FROM {src} s LEFT JOIN (
  SELECT p.id, string_agg(substr(x.t, p.prev + 1, p."start" - p.prev) || p.r, '' ORDER BY p."start") AS body,
         max(p."end") AS last_end
  FROM (SELECT id, "start", "end", {replacement} AS r,
               coalesce(lag("end") OVER (PARTITION BY id ORDER BY "start"), 0) AS prev FROM tk) p
  JOIN {src} x ON x.id = p.id GROUP BY p.id) b ON b.id = s.id"""


def with_ctes(body: str, ctes: list[tuple[str, str]]) -> str:
    return with_views(body, *ctes)


# --- Spark helpers ---------------------------------------------------------------------------
def _docs(spark, d):
    return T(spark, d)["documents"].select("doc_id", "source", "text")


def _notes(spark, d):
    return T(spark, d)["contract_notes"].select("ContractId", F.col("CustomerId").alias("session_id"), "note")


def _profiles(spark, d):
    return T(spark, d)["customers"].withColumn("session_id", F.col("Id"))


def _known(spark, d):
    return V.register_known(_profiles(spark, d))


def _span_rows(df, keys, text_col, spans_col):
    return (df.select(*keys, text_col, F.explode(spans_col).alias("s"))
            .select(*keys, "s.start", "s.end", S.span_text(F.col(text_col), F.col("s")).alias("value"), "s.entity"))


def _notes_masked(spark, d):
    return M.mask_text(_notes(spark, d), "note", ["ContractId"], known_values=_known(spark, d))


def _docs_masked(spark, d):
    return M.mask_text(_docs(spark, d), "text", ["doc_id"], session_col="source")


# --- D1-D4, F4: regex detectors on the documents corpus ---------------------------------------
def _detect(entity):
    def fn(spark, d):
        return _span_rows(_docs(spark, d), ["doc_id"], "text", S.regex_spans(F.col("text"), entity)).drop("entity")
    return fn


@query("detect_ssn", None)
def q_detect_ssn(spark, d):
    """D1 over the documents and the contract notes (documents hold no SSN of their own)."""
    texts = _docs(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        _notes(spark, d).select(F.lit("note").alias("kind"), F.col("ContractId").alias("id"), F.col("note").alias("text")))
    return _span_rows(texts, ["kind", "id"], "text", S.regex_spans(F.col("text"), "SSN")).drop("entity")


REGISTRY["detect_ssn"] = (q_detect_ssn, with_views(
    "SELECT 'document' AS kind, * FROM (" + f"SELECT id, \"start\", \"end\", value FROM ({sql_regex_spans(DOCS_SRC, 'id', 'SSN')}) z" + ") a "
    "UNION ALL SELECT 'note', * FROM (" + f"SELECT id, \"start\", \"end\", value FROM ({sql_regex_spans(NOTES_SRC, 'id', 'SSN')}) y" + ") b"))

for _name, _ent in (("detect_card", "CREDIT_CARD"), ("detect_email", "EMAIL"),
                    ("detect_phone", "PHONE")):
    REGISTRY[_name] = (_detect(_ent), with_views(
        f"SELECT id AS doc_id, \"start\", \"end\", value FROM ({sql_regex_spans(DOCS_SRC, 'id', _ent)}) z"))


@query("fn_luhn", None)
def q_fn_luhn(spark, d):
    """card-shaped candidates with their checksum verdict."""
    docs = _docs(spark, d)
    off = S.match_offsets(F.col("text"), P.REGEXES["CREDIT_CARD"])
    return (docs.select("doc_id", "text", F.explode(off).alias("o"))
            .select("doc_id", F.col("o.start").alias("start"), S.span_text(F.col("text"), F.col("o")).alias("value"))
            .withColumn("luhn_ok", S.luhn_ok(F.col("value"))))


REGISTRY["fn_luhn"] = (q_fn_luhn, with_views(
    f"SELECT id AS doc_id, \"start\", value, {sql_luhn('value')} AS luhn_ok "
    f"FROM ({sql_offsets_2pass(DOCS_SRC, 'id', _q(P.RE2['CREDIT_CARD']))}) z"))


# --- T1, W5, D5: known values ---------------------------------------------------------------
@query("known_register", None)
def q_known_register(spark, d):
    return _known(spark, d).drop("reg_order")


REGISTRY["known_register"] = (q_known_register, with_ctes(
    "SELECT session_id, norm, value, entity FROM kv", [("kv", KV_SQL)]))


@query("known_values_ranked", None)
def q_known_values_ranked(spark, d):
    return V.known_values_ranked(_known(spark, d)).select("session_id", "value", "entity", "rank")


REGISTRY["known_values_ranked"] = (q_known_values_ranked, with_ctes(
    "SELECT session_id, value, entity, row_number() OVER (PARTITION BY session_id ORDER BY length(value) DESC, col_idx) AS rank FROM kv",
    [("kv", KV_SQL)]))


@query("detect_known", None)
def q_detect_known(spark, d):
    notes = _notes(spark, d)
    kn = V.session_known(_known(spark, d))
    j = notes.join(kn, "session_id")
    return _span_rows(j, ["ContractId"], "note", S.known_spans(F.col("note"), F.col("known")))


REGISTRY["detect_known"] = (q_detect_known, with_ctes(
    "SELECT id AS ContractId, \"start\", \"end\", value, entity FROM known", [("kv", KV_SQL), ("known", sql_known_spans())]))


# --- D9, D11, D12: resolution -----------------------------------------------------------------
def _notes_raw_spans(spark, d):
    notes = _notes(spark, d)
    kn = V.session_known(_known(spark, d))
    j = notes.join(kn, "session_id", "left")
    known = F.coalesce(F.col("known"), F.array().cast(M.KNOWN))
    return j.withColumn("raw", M.detected_spans(F.col("note"), known))


@query("resolve_spans", None)
def q_resolve_spans(spark, d):
    j = _notes_raw_spans(spark, d)
    return _span_rows(j, ["ContractId"], "note", S.resolve(F.col("note"), F.col("raw")))


REGISTRY["resolve_spans"] = (q_resolve_spans, with_ctes(
    "SELECT id AS ContractId, \"start\", \"end\", value, entity FROM chosen", [("kv", KV_SQL)] + sql_chosen(NOTES_SRC, True)))


@query("allow_list_filter", None)
def q_allow_list_filter(spark, d):
    """D9 on every word of the notes and conversations: which words the allow-list keeps unmasked."""
    t = T(spark, d)
    texts = t["conversations"].select("text").unionByName(t["contract_notes"].select(F.col("note").alias("text")))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"(?U)\S+"), F.lit(0))
    return (texts.select(F.explode(words).alias("word"))
            .where(DEFAULT.allows(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n")))


REGISTRY["allow_list_filter"] = (q_allow_list_filter, with_views(f"""
SELECT value AS word, COUNT(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS value FROM
  (SELECT text FROM conversations UNION ALL SELECT note FROM contract_notes) x) w
WHERE {ALLOW_SQL} GROUP BY value"""))


@query("possessive_trim", None)
def q_possessive_trim(spark, d):
    """Known-value spans of the notes followed by 's, trimmed (notes + a possessive suffix on the name)."""
    notes = _notes(spark, d).withColumn("note", F.regexp_replace("note", r"^Reach (\S+ \S+) at", "Reach $1's at"))
    kn = V.session_known(_known(spark, d))
    j = notes.join(kn, "session_id")
    trimmed = S.trim_possessive(F.col("note"), S.known_spans(F.col("note"), F.col("known")))
    return _span_rows(j, ["ContractId"], "note", trimmed)


@query("protected_spans", "SELECT ContractId, CAST(0 AS INTEGER) AS kept_spans FROM contract_notes")
def q_protected_spans(spark, d):
    """Re-masking masked notes finds nothing outside existing tokens (idempotence): spans that
    survive protection, expected none in any note."""
    m = _notes_masked(spark, d).cells
    j = m.join(V.session_known(_known(spark, d)), "session_id", "left")
    known = F.coalesce(F.col("known"), F.array().cast(M.KNOWN))
    raw = M.detected_spans(F.col("masked"), known)
    kept = S.drop_protected(F.col("masked"), raw)
    return j.select("ContractId", F.size(kept).alias("kept_spans"))


# --- T2-T5, M4, A11, M6: tokens and masking on the notes ----------------------------------------
_NOTE_CTES = [("kv", KV_SQL)] + sql_chosen(NOTES_SRC, True)


@query("token_assignment", None)
def q_token_assignment(spark, d):
    return _notes_masked(spark, d).vault.select("session_id", "entity", "norm", "value", "n", "token")


REGISTRY["token_assignment"] = (q_token_assignment, with_ctes(
    "SELECT session_id, entity, norm, value, n, '<' || entity || '_' || CAST(n AS VARCHAR) || '>' AS token FROM vault",
    _NOTE_CTES))


@query("mask_text_notes", None)
def q_mask_text_notes(spark, d):
    return _notes_masked(spark, d).cells.select("ContractId", "masked")


REGISTRY["mask_text_notes"] = (q_mask_text_notes, with_ctes(
    f"SELECT id AS ContractId, masked FROM ({sql_masked(NOTES_SRC)}) m", _NOTE_CTES))


@query("pii_counts", None)
def q_pii_counts(spark, d):
    """Values masked per entity type over all notes (merge of the per-row counters)."""
    cells = _notes_masked(spark, d).cells
    return (cells.select(F.explode("pii_counts").alias("entity", "n"))
            .groupBy("entity").agg(F.sum("n").cast("long").alias("masked")))


REGISTRY["pii_counts"] = (q_pii_counts, with_ctes(
    "SELECT entity, COUNT(*) AS masked FROM chosen GROUP BY entity", _NOTE_CTES))


@query("unmask_answers", None)
def q_unmask_answers(spark, d):
    m = _notes_masked(spark, d)
    return M.unmask(m.cells.select("ContractId", "session_id", "masked"), "masked", ["ContractId"], m.vault) \
        .select("ContractId", "unmasked")


_REVEAL_SQL = ("CASE WHEN entity IN (" + ", ".join(_q(e) for e, r in P.ENTITY_TYPES.items() if r)
               + f") THEN vault_value ELSE {_q(P.REDACTED)} END")
REGISTRY["unmask_answers"] = (q_unmask_answers, with_ctes(
    f"SELECT id AS ContractId, masked AS unmasked FROM ({sql_masked(NOTES_SRC, _REVEAL_SQL)}) m", _NOTE_CTES))


@query("token_lookup", None)
def q_token_lookup(spark, d):
    """Every token written into a masked note, looked up back (all known)."""
    m = _notes_masked(spark, d)
    toks = m.cells.select("session_id", F.explode(F.regexp_extract_all("masked", F.lit(P.TOKEN_PATTERN), F.lit(0)))
                          .alias("token")).distinct()
    return V.token_lookup(m.vault, toks)


REGISTRY["token_lookup"] = (q_token_lookup, with_ctes(
    "SELECT DISTINCT o.session_id, t.token, v.value FROM tk t JOIN occ o ON o.id = t.id AND o.\"start\" = t.\"start\" "
    "JOIN vault v ON v.session_id = o.session_id AND '<' || v.entity || '_' || CAST(v.n AS VARCHAR) || '>' = t.token",
    _NOTE_CTES))


@query("vault_summary", None)
def q_vault_summary(spark, d):
    m = _notes_masked(spark, d)
    return V.vault_summary(m.vault).select("session_id", "tokens", "entity_types")


REGISTRY["vault_summary"] = (q_vault_summary, with_ctes(
    "SELECT session_id, COUNT(*) AS tokens, COUNT(DISTINCT entity) AS entity_types FROM vault GROUP BY session_id",
    _NOTE_CTES))


@query("token_extend", None)
def q_token_extend(spark, d):
    """T5: notes masked in two batches (Lease contracts first, then Loans) with the vault carried over;
    must equal one pass over Lease-then-Loan order."""
    notes = _notes(spark, d).withColumn("batch", (F.col("ContractId") % 3 == 0).cast("int"))
    kv = _known(spark, d)
    first = M.mask_text(notes.where(F.col("batch") == 0), "note", ["ContractId"], known_values=kv)
    second = M.mask_text(notes.where(F.col("batch") == 1), "note", ["ContractId"], known_values=kv, vault=first.vault)
    return second.vault.select("session_id", "entity", "norm", "n")


REGISTRY["token_extend"] = (q_token_extend, with_ctes(
    """SELECT session_id, entity, norm, row_number() OVER (PARTITION BY session_id, entity
         ORDER BY CASE WHEN first_id % 3 = 0 THEN 1 ELSE 0 END, first_id, first_start DESC) AS n FROM (
       SELECT session_id, entity, norm, id AS first_id, "start" AS first_start FROM (
         SELECT *, row_number() OVER (PARTITION BY session_id, entity, norm
                                      ORDER BY CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END, id, "start" DESC) AS rn FROM occ) f
       WHERE rn = 1) g""", _NOTE_CTES))


# --- M4 on documents, M5, G1-G3 ---------------------------------------------------------------
_DOC_CTES = sql_chosen(DOCS_SRC, False)


@query("mask_text_documents", None)
def q_mask_text_documents(spark, d):
    return _docs_masked(spark, d).cells.select("doc_id", "masked")


REGISTRY["mask_text_documents"] = (q_mask_text_documents, with_ctes(
    f"SELECT id AS doc_id, masked FROM ({sql_masked(DOCS_SRC)}) m", _DOC_CTES))


ERROR_CHARS = 300  # fixed value: characters of an error line that are shown


@query("mask_error_text", None)
def q_mask_error_text(spark, d):
    """M5: error lines (documents) masked, then cut to what is shown."""
    return M.mask_errors(_docs(spark, d), "text", ["doc_id"], limit=ERROR_CHARS, session_col="source").cells.select("doc_id", "error_text")


REGISTRY["mask_error_text"] = (q_mask_error_text, with_ctes(
    f"SELECT id AS doc_id, substr(masked, 1, 300) AS error_text FROM ({sql_masked(DOCS_SRC)}) m", _DOC_CTES))


@query("guard_mask", None)
def q_guard_mask(spark, d):
    """G1: outgoing payloads (documents) re-scanned and masked; findings per payload and type."""
    out, _ = M.guard(_docs(spark, d), "text", ["doc_id"], session_col="source", mode="mask")
    return out.select("doc_id", F.explode("findings").alias("entity", "n"))


REGISTRY["guard_mask"] = (q_guard_mask, with_ctes(
    "SELECT id AS doc_id, entity, CAST(COUNT(*) AS INTEGER) AS n FROM chosen GROUP BY id, entity", _DOC_CTES))


@query("guard_block", None)
def q_guard_block(spark, d):
    """Block mode: payloads with any finding are refused; counts only."""
    passed, blocked = M.guard(_docs(spark, d), "text", ["doc_id"], session_col="source", mode="block")
    return blocked.select("doc_id", F.explode("findings").alias("entity", "n"))


REGISTRY["guard_block"] = (q_guard_block, REGISTRY["guard_mask"][1])


def _leak_values(spark, d):
    """Every customer's PII value (length >= 3), their SSNs and full names."""
    cu = T(spark, d)["customers"]
    cols = [c for c, _ in P.PROFILE_TYPES] + ["SSN"]
    ents = dict(P.PROFILE_TYPES, SSN="SSN")
    vals = cu.select(F.explode(F.array(*[F.struct(F.col(c).alias("value"), F.lit(ents[c]).alias("entity")) for c in cols]
                                       + [F.struct(F.concat(F.col("FirstName"), F.lit(" "), F.col("LastName")).alias("value"),
                                                   F.lit("PERSON").alias("entity"))])).alias("v")).select("v.*")
    return vals


@query("leak_scan", None)
def q_leak_scan(spark, d):
    """G3 over the raw notes: which customer values appear in which note (all customers x all notes)."""
    notes = _notes(spark, d)
    return M.leak_scan(notes, "note", ["ContractId"], _leak_values(spark, d)).distinct()


_LEAK_CTES = [
    ("vals", """SELECT DISTINCT value, entity FROM (
    SELECT trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS value, entity FROM (
      SELECT FirstName AS raw, 'PERSON' AS entity FROM customers UNION ALL SELECT LastName, 'PERSON' FROM customers
      UNION ALL SELECT AddressLine1, 'ADDRESS' FROM customers UNION ALL SELECT AddressLine2, 'ADDRESS' FROM customers
      UNION ALL SELECT Zip, 'ZIP' FROM customers UNION ALL SELECT Phone, 'PHONE' FROM customers
      UNION ALL SELECT Email, 'EMAIL' FROM customers UNION ALL SELECT SSN, 'SSN' FROM customers
      UNION ALL SELECT FirstName || ' ' || LastName, 'PERSON' FROM customers) u WHERE raw IS NOT NULL) x
  WHERE length(value) >= 3"""),
    ("vw", "SELECT value, entity, unnest(string_split_regex(lower(value), '[^\\p{L}\\p{N}_]+')) AS word FROM vals"),
    ("nw", "SELECT DISTINCT ContractId, unnest(string_split_regex(lower(note), '[^\\p{L}\\p{N}_]+')) AS word "
           "FROM contract_notes"),
    ("cand", "SELECT DISTINCT n.ContractId, v.value, v.entity FROM nw n JOIN vw v ON v.word = n.word AND v.word <> ''"),
    ("src", "SELECT c.ContractId, c.entity, c.value AS canon, c.value, cn.note AS t FROM cand c "
            "JOIN contract_notes cn ON cn.ContractId = c.ContractId"),
]
REGISTRY["leak_scan"] = (q_leak_scan, with_views(
    "SELECT DISTINCT ContractId, entity, canon AS value FROM (" + sql_literal_offsets("src", "ContractId, entity, canon")
    + ") o", *_LEAK_CTES))


@query("leak_scan_masked", """SELECT CAST(NULL AS BIGINT) AS ContractId, '' AS entity, '' AS value WHERE FALSE""")
def q_leak_scan_masked(spark, d):
    """G3 after masking: no customer value may survive in any masked note (expected: no rows)."""
    m = _notes_masked(spark, d).cells.select("ContractId", "masked")
    return M.leak_scan(m, "masked", ["ContractId"], _leak_values(spark, d)).distinct()


_TOGGLES = {  # policy files with detectors switched on and off
    "all": {},
    "regex_only": {"detectors": {"known_values": {"enabled": False}}},
    "known_only": {"detectors": {"regex": []}},
    "long_known_email": {"detectors": {"regex": ["EMAIL"], "known_values": {"min_length": 8}}},
}


@query("detector_toggle", None)
def q_detector_toggle(spark, d):
    """Spans found in the notes under policies with different detector sets."""
    out = None
    for name, doc in _TOGGLES.items():
        policy = from_mapping(doc)
        j = _notes(spark, d).join(V.session_known(_known(spark, d), policy), "session_id", "left")
        raw = M.detected_spans(F.col("note"), F.coalesce(F.col("known"), F.array().cast(M.KNOWN)), policy=policy)
        n = F.size(S.resolve(F.col("note"), F.col("raw"), policy))
        part = j.withColumn("raw", raw).agg(F.sum(n).cast("long").alias("spans")).select(F.lit(name).alias("policy"), "spans")
        out = part if out is None else out.unionByName(part)
    return out


def _toggle_sql() -> str:
    ctes = [("kv", KV_SQL)]
    parts = []
    for name, keep in (("all", "TRUE"), ("regex_only", f"rank < {P.entity_rank('PERSON', 'known')}"),
                       ("known_only", f"rank >= {P.entity_rank('PERSON', 'known')}"),
                       ("long_known_email", f"(entity = 'EMAIL' AND rank < {P.entity_rank('PERSON', 'known')}) OR "
                                            f"(rank >= {P.entity_rank('PERSON', 'known')} AND length(value) >= 8)")):
        chosen = [(f"{c}_{name}", sql) for c, sql in sql_chosen(NOTES_SRC, True)[:4]]
        for c in ("sp_raw", "sp_ok", "sp"):
            chosen = [(n, _word(c, f"{c}_{name}", sql)) for n, sql in chosen]
        chosen[0] = (chosen[0][0], f"SELECT * FROM ({chosen[0][1]}) t WHERE {keep}")
        ctes += chosen
        parts.append(f"SELECT '{name}' AS policy, (SELECT count(*) FROM chosen_{name}) AS spans")
    return with_ctes("\nUNION ALL ".join(parts), ctes)


def _word(old: str, new: str, sql: str) -> str:
    import re
    return re.sub(rf"\b{old}\b", new, sql)


REGISTRY["detector_toggle"] = (q_detector_toggle, _toggle_sql())


# --- M4 on pages ------------------------------------------------------------------------------
PAGES_SRC = "(SELECT page_id AS id, url AS session_id, html AS t FROM pages)"


@query("mask_text_pages", None)
def q_mask_text_pages(spark, d):
    """M4 on raw web pages (one session per page URL)."""
    pages = T(spark, d)["pages"].select("page_id", "url", "html")
    return M.mask_text(pages, "html", ["page_id"], session_col="url").cells.select("page_id", "masked")


REGISTRY["mask_text_pages"] = (q_mask_text_pages, with_ctes(
    f"SELECT id AS page_id, masked FROM ({sql_masked(PAGES_SRC)}) m", sql_chosen(PAGES_SRC, False)))


_POSS_SRC = ("(SELECT n.id, n.session_id, n.t, kv.value, kv.entity FROM (SELECT ContractId AS id, CustomerId AS session_id, "
             "regexp_replace(note, '^Reach (\\S+ \\S+) at', 'Reach \\1''s at') AS t FROM contract_notes) n "
             f"JOIN kv ON kv.session_id = n.session_id WHERE length(kv.value) >= {P.KNOWN_VALUE_MIN_LENGTH})")
REGISTRY["possessive_trim"] = (REGISTRY["possessive_trim"][0], with_ctes(
    "SELECT id AS ContractId, \"start\", \"end\", value, entity FROM ("
    + sql_literal_offsets(_POSS_SRC, "id, session_id, entity") + ") p", [("kv", KV_SQL)]))
