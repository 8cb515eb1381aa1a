"""Conversation turns, history windows and audit records.

Each user turn of ``conversations`` is a question; the next assistant turn is its answer. Turn numbers
come from ``rank_within`` (a very long conversation is still spread over tasks) and the last-three
history is one aggregation by (conversation, turn) instead of a window that would hold a whole
conversation in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerguard.functions.text import payload_digest
from ledgerguard.operators import contracts as K
from ledgerguard.operators import masking as M
from ledgerguard.operators.vault import register_known
from ledgerguard.plans.ranking import rank_within
from ledgerguard.sources.policy import DEFAULT, Policy

COUNTS = "map<string,int>"
CALL = f"struct<node:string,chars:int,sha256:string,guard_masked:{COUNTS},payload:string>"
AUDIT_READ_SCHEMA = (
    "ts string, session_id long, turn long, sequence_number string, question string, answer string, outcome string, "
    f"intent string, sql string, sql_attempts int, sql_errors array<string>, row_count long, pii_input {COUNTS}, "
    f"pii_columns map<string,string>, pii_masked_output {COUNTS}, pii_guard_masked {COUNTS}, llm_calls array<{CALL}>, latency_ms long")


def conversation_turns(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, turn_number, question, answer) per user turn; answer = the next assistant turn."""
    users = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    answers = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = users.join(answers, ["conv_id", "turn"], "left")
    return rank_within(pairs, ["conv_id"], ["turn"], out="turn_number")


def history_last(turns: DataFrame, k: int = 3) -> DataFrame:
    """The previous ``k`` (question, answer) pairs of each turn as prev1..prevk columns (prev1 = latest).
    Each turn is sent to the k turns after it and to itself, and one aggregation by (conversation, turn) puts
    them in place: one pass over ``turns``, no window over a conversation."""
    targets = F.explode(F.sequence(F.lit(0), F.lit(k))).alias("j")
    sent = turns.select("conv_id", "turn_number", "question", "answer", targets)
    sent = sent.withColumn("turn_number", F.col("turn_number") + F.col("j"))
    def place(j: int, column: str):
        return F.max(F.when(F.col("j") == j, F.col(column))).alias(f"prev{j}_{column}")
    cols = [place(j, c) for j in range(1, k + 1) for c in ("question", "answer")]
    own = F.max(F.when(F.col("j") == 0, F.lit(True))).alias("_own")
    return sent.groupBy("conv_id", "turn_number").agg(own, *cols).where("_own").drop("_own")


NOT_ASKED = "LEDGERGUARD_NOT_ASKED"


def with_notes(turns: DataFrame, notes: DataFrame | None, asked: DataFrame | None = None) -> DataFrame:
    """Turns of the user with the note of the contract they talk about (``ContractId``, ``note``) behind the text. Notes that
    no turn asks for are not made. A stream's turns cannot be read ahead of it, so ``asked`` (``conv_id``, distinct) says which
    conversations it has; a turn of another one fails with ``NOT_ASKED``, instead of going without its note."""
    if notes is None:
        return turns
    notes = notes.select(F.col("ContractId").alias("_contract"), "note")
    if asked is not None:
        ids = asked.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("_contract"))
        notes = ids.join(notes.join(ids, "_contract", "left_semi"), "_contract", "left")
        known = F.col("_contract").isNotNull() | F.col("conv_id").isNull()
        turns = turns.join(notes, F.col("conv_id") == F.col("_contract"), "left")
        role = F.when(known, F.col("role")).otherwise(F.raise_error(F.lit(NOT_ASKED)))
        text = F.when((role == "user") & F.col("note").isNotNull(), F.concat_ws(" | ", "text", "note")).otherwise(F.col("text"))
        return turns.withColumn("text", text).drop("_contract", "note")
    if not turns.isStreaming:
        notes = notes.join(turns.select(F.col("conv_id").alias("_contract")).distinct(), "_contract", "left_semi")
    text = F.when((F.col("role") == "user") & F.col("note").isNotNull(), F.concat_ws(" | ", "text", "note")).otherwise(F.col("text"))
    return turns.join(notes, F.col("conv_id") == F.col("_contract"), "left").withColumn("text", text).drop("_contract", "note")


def with_event_time(df: DataFrame) -> DataFrame:
    """The table has no times: turn ``t`` of conversation ``c`` happens at 2024-01-01 + c days + t * 25 min * (1 + c % 4)."""
    gap = F.col("turn") * 25 * 60 * (1 + F.col("conv_id") % 4)
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return df.withColumn("ts", (base.cast("long") + F.col("conv_id") * 86400 + gap).cast("timestamp"))


def masked_conversations(t: dict, policy: Policy = DEFAULT) -> M.Masked:
    """Every turn (the user's with the conversation's contract note behind it) masked in one pass, by the order of
    turns, with the known values of the contract's customer. One vault serves questions and answers."""
    turns = with_notes(t["conversations"].select("conv_id", "turn", "role", "text"), t["contract_notes"])
    return M.mask_text(turns, "text", ["conv_id", "turn"], ["turn"], session_col="conv_id", known_values=_known_of_conversations(t), policy=policy)


def _known_of_conversations(t: dict) -> DataFrame:
    """The known values of the customers whose contracts the conversations talk about; others are asked for by no session."""
    talked = t["conversations"].select(F.col("conv_id").alias("ContractId")).distinct()
    lf, ln = (t[n].join(talked, "ContractId", "left_semi") for n in ("leasefinances", "loanfinances"))
    return register_known(K.contract_customer(lf, ln, t["customers"]).withColumn("session_id", F.col("ContractId")))


def _merge(*maps):
    """Counts added up over maps."""
    out = F.create_map().cast(COUNTS)
    for m in maps:
        out = F.map_zip_with(out, F.coalesce(m, F.create_map().cast(COUNTS)), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return out


def _call(node: str, payload, found, policy: Policy):
    """One outgoing payload: size, digest, what the guard found; the (masked) payload only if the policy keeps it."""
    chars, sha = payload_digest(F.coalesce(payload, F.lit("")))
    kept = payload if policy.exit.keep_payloads else F.lit(None).cast("string")
    return F.struct(F.lit(node).alias("node"), chars.alias("chars"), sha.alias("sha256"), found.alias("guard_masked"), kept.alias("payload"))


def audit_records(spark: SparkSession, t: dict, policy: Policy = DEFAULT, guard_policy: Policy | None = None) -> DataFrame:
    """L1: one record per question turn. Questions and answers are masked in one pass over all turns
    (``masked_conversations``) and the guard looks over what that left, in one pass more. Intent, rows and outcome come
    from the request of the conversation (R2); a conversation without a contract is an ``error``. ``ts`` is the time of
    the turn. There is no SQL generator here, so ``sql`` is null, an ad-hoc question has one attempt with one error,
    and the columns of the core answers hold no personal data. ``latency_ms`` is not in the data. No raw PII leaves
    this function. ``guard_policy``: what the guard looks for, if not what the masking does."""
    m = masked_conversations(t, policy)
    said = m.cells.select("conv_id", "turn", "role", F.col("text").isNull().alias("none"), "masked", F.col("pii_counts").alias("counts"))
    said, _ = M.guard(said, "masked", ["conv_id", "turn"], session_col="conv_id", known_values=_known_of_conversations(t),
                      policy=guard_policy or policy, mode="mask")
    parts = F.struct(F.when(~F.col("none"), F.col("guarded")).alias("text"), F.col("guarded").alias("sent"), "counts", "findings")
    said = said.select("conv_id", "turn", "role", parts.alias("x"))
    users = said.where(F.col("role") == "user").select("conv_id", "turn", F.col("x").alias("q"))
    replies = said.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("a"))
    rec = with_event_time(rank_within(users.join(replies, ["conv_id", "turn"], "left"), ["conv_id"], ["turn"], out="turn_number"))
    requests = t["requests"].join(t["conversations"].select(F.col("conv_id").alias("request_id")).distinct(), "request_id", "left_semi")
    asked = K.answer_requests(requests, t).select(F.col("request_id").alias("_request"), "intent", F.col("outcome").alias("_o"), "row_count")
    rec = rec.join(asked, F.col("conv_id") == F.col("_request"), "left")
    found = _merge(F.col("q.findings"), F.col("a.findings"))
    calls = F.filter(F.array(
        _call("classify_intent", F.col("q.sent"), F.col("q.findings"), policy),
        F.when(F.col("intent") == "adhoc", _call("generate_sql", F.col("q.sent"), F.col("q.findings"), policy)),
        F.when(F.col("a.text").isNotNull(), _call("compose_answer", F.col("a.text"), F.col("a.findings"), policy))), lambda c: c.isNotNull())
    adhoc = F.col("_o") == "gave_up"
    outcome = (F.when(F.col("_o").isNull() | (F.col("_o") == "not_found"), "error")
               .when(adhoc | F.col("a.text").isNull(), "gave_up").otherwise("answered"))
    return rec.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts"),
        F.col("conv_id").alias("session_id"), F.col("turn_number").alias("turn"),
        F.concat(F.lit("CT-"), F.col("conv_id").cast("string")).alias("sequence_number"),
        F.col("q.sent").alias("question"), F.col("a.text").alias("answer"),
        outcome.alias("outcome"), "intent", F.lit(None).cast("string").alias("sql"),
        F.when(adhoc, 1).otherwise(0).cast("int").alias("sql_attempts"),
        F.when(adhoc, F.array(F.lit("no generator"))).otherwise(F.array().cast("array<string>")).alias("sql_errors"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"), F.col("q.counts").alias("pii_input"),
        F.create_map().cast("map<string,string>").alias("pii_columns"), F.coalesce(F.col("a.counts"), F.create_map().cast(COUNTS)).alias("pii_masked_output"),
        found.alias("pii_guard_masked"), calls.alias("llm_calls"), F.lit(None).cast("long").alias("latency_ms"))


def counts_text(counts) -> F.Column:
    """``EMAIL=1,PHONE=2``"""
    entries = F.transform(F.map_entries(counts), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.coalesce(F.array_join(F.array_sort(entries), ","), F.lit(""))


def flat_records(audit: DataFrame) -> DataFrame:
    """The records with their counts and calls as text, one column each."""
    maps = ("pii_input", "pii_masked_output", "pii_guard_masked")
    return audit.select("ts", "session_id", "turn", "sequence_number", "question", "answer", "outcome", "intent", "sql", "sql_attempts",
                        F.array_join("sql_errors", ",").alias("sql_errors"), "row_count", *[counts_text(F.col(c)).alias(c) for c in maps],
                        F.array_join(F.transform("llm_calls", lambda c: c["node"]), ",").alias("llm_calls"))


def guard_totals(audit: DataFrame) -> DataFrame:
    """L2: guard findings merged over all calls of each turn (non-zero means an earlier layer missed)."""
    calls = audit.select("session_id", "turn", F.explode("llm_calls").alias("c"))
    return (calls.select("session_id", "turn", F.explode("c.guard_masked").alias("entity", "n"))
            .groupBy("session_id", "turn", "entity").agg(F.sum("n").cast("long").alias("n")))


def call_metadata(audit: DataFrame) -> DataFrame:
    """L3: one row per outgoing payload."""
    return (audit.select("session_id", "turn", F.explode("llm_calls").alias("c"))
            .select("session_id", "turn", "c.node", "c.chars", "c.sha256", F.size("c.guard_masked").alias("guard_types"),
                    F.col("c.payload").isNotNull().alias("payload_kept")))


def write_audit(audit: DataFrame, path: str, run: str) -> None:
    """JSON lines, one per turn, in the folder of this run: writing a run again replaces it, other runs stay."""
    audit.write.mode("overwrite").json(f"{path.rstrip('/')}/run={run}")


def audit_rollup(audit: DataFrame) -> DataFrame:
    """L4: outcomes, attempts and PII values by type, per day and session."""
    day = F.substring("ts", 1, 10).alias("day")
    per = audit.groupBy(day, "session_id").agg(
        F.count(F.lit(1)).alias("turns"), *[F.sum((F.col("outcome") == o).cast("int")).alias(o) for o in ("answered", "gave_up", "error")],
        F.sum("sql_attempts").alias("attempts"))
    typed = (audit.select(day, "session_id", F.explode("pii_input").alias("entity", "n"))
             .groupBy("day", "session_id", "entity").agg(F.sum("n").cast("long").alias("n"))
             .groupBy("day", "session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "entity", "n"))), ",").alias("pii_input")))
    return per.join(typed, ["day", "session_id"], "left").withColumn("pii_input", F.coalesce("pii_input", F.lit("")))
