"""Streaming queries: each runs its stream to completion (``Trigger.AvailableNow``) into the shared folder
and returns the sink read back, so the result can be compared with a batch formulation."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ledgerguard.plans.catalog import REGISTRY, T, query
from ledgerguard.plans.catalog_pii import sql_chosen, sql_masked
from ledgerguard.plans.oracle_views import with_views
from ledgerguard.session import scratch_path
from ledgerguard.streaming import pipeline as SP

# the turns of a user carry the note of their contract, so that there is something to mask
CONV_SRC = """(SELECT conv_id * 100000 + turn AS id, conv_id AS session_id,
  CASE WHEN role = 'user' AND note IS NOT NULL THEN text || ' | ' || note ELSE text END AS t
  FROM conversations LEFT JOIN contract_notes ON ContractId = conv_id)"""


def _notes(spark, d):
    return T(spark, d)["contract_notes"].select("ContractId", "note")


@query("stream_mask", None)
def q_stream_mask(spark, d):
    """ST1: every arriving turn masked (batch masking per micro-batch, vault carried across batches)."""
    return spark.read.parquet(SP.stream_mask(spark, d, notes=_notes(spark, d))).select("conv_id", "turn", "masked")


REGISTRY["stream_mask"] = (q_stream_mask, with_views(
    f"SELECT id // 100000 AS conv_id, id % 100000 AS turn, masked FROM ({sql_masked(CONV_SRC)}) m",
    *sql_chosen(CONV_SRC, False)))


@query("stream_audit", None)
def q_stream_audit(spark, d):
    """ST3: one appended audit record per turn (length, digest, findings)."""
    return spark.read.schema(SP.AUDIT_STREAM_SCHEMA).json(SP.stream_audit(spark, d, notes=_notes(spark, d)))


REGISTRY["stream_audit"] = (q_stream_audit, with_views(
    f"""SELECT c.conv_id, c.turn, c.role, length(s.t) AS chars, substr(sha256(s.t), 1, 16) AS sha256,
  CAST(coalesce(f.n, 0) AS INTEGER) AS findings
FROM conversations c JOIN {CONV_SRC} s ON s.id = c.conv_id * 100000 + c.turn LEFT JOIN (SELECT id, COUNT(*) AS n FROM chosen GROUP BY id) f
  ON f.id = c.conv_id * 100000 + c.turn""", *sql_chosen(CONV_SRC, False)[:4]))


def _closing():
    """Turns after which a session is closed."""
    return (F.col("conv_id") % 5 == 0) & (F.col("turn") == 2) & (F.col("role") != "assistant")


@query("stream_vault", None)
def q_stream_vault(spark, d):
    """ST2: session vault as keyed state with an event-time idle TTL and a close event; uses after either fail closed."""
    decided = spark.read.schema(SP.DECISION_SCHEMA).parquet(SP.stream_vault(spark, d, notes=_notes(spark, d), closes=_closing()))
    return SP.masked_turns(SP.with_notes(T(spark, d)["conversations"], _notes(spark, d)), decided)


# A session ends when two turns are more than an hour apart (turns are 25 * (1 + conv_id % 4) minutes apart), or with a closing turn.
REGISTRY["stream_vault"] = (REGISTRY["stream_vault"][0], with_views(f"""
SELECT c.conv_id, c.turn, CASE WHEN ok THEN m.masked END AS masked, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status
FROM (SELECT conv_id, turn, coalesce(bool_and(gap <= 60) OVER (PARTITION BY conv_id ORDER BY turn), TRUE)
             AND NOT coalesce(bool_or(closing) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ok FROM (
  SELECT conv_id, turn, conv_id % 5 = 0 AND turn = 2 AND role <> 'assistant' AS closing,
         (turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)) * 25 * (1 + conv_id % 4) AS gap FROM conversations) g) c
JOIN ({sql_masked(CONV_SRC)}) m ON m.id = c.conv_id * 100000 + c.turn""", *sql_chosen(CONV_SRC, False)))


@query("stream_vault_values", None)
def q_stream_vault_values(spark, d):
    """ST2 + T3: the values of all tokens the stream gave, opened by the keys in its state: none for a session that is closed."""
    out, secret = scratch_path(spark, "stream-vault"), os.urandom(32)
    decided = spark.read.schema(SP.DECISION_SCHEMA).parquet(SP.stream_vault(spark, d, out, notes=_notes(spark, d), secret=secret, closes=_closing()))
    closed = SP.with_notes(T(spark, d)["conversations"], _notes(spark, d)).where(_closing()).select(F.col("conv_id").alias("session_id")).distinct()
    return SP.reveal(decided, SP.live_keys(spark, out, secret)).join(closed, "session_id", "left_semi")


REGISTRY["stream_vault_values"] = (q_stream_vault_values, with_views("""
SELECT DISTINCT o.session_id, t.token, t.entity, CAST(NULL AS VARCHAR) AS value
FROM tk t JOIN occ o ON o.id = t.id AND o."start" = t."start"
JOIN (SELECT conv_id FROM conversations WHERE conv_id % 5 = 0 AND turn = 2 AND role <> 'assistant') c ON c.conv_id = o.session_id
WHERE t.id % 100000 <= 2 AND (SELECT coalesce(max(gap), 0) <= 60 FROM (
  SELECT conv_id, turn, (turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)) * 25 * (1 + conv_id % 4) AS gap FROM conversations) g
  WHERE g.conv_id = o.session_id AND g.turn <= t.id % 100000)""", *sql_chosen(CONV_SRC, False)))
