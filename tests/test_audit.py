"""Audit records, calls, roll-up and the JSON sink."""
from dataclasses import replace

import pytest

from ledgerguard.operators import audit as A
from ledgerguard.sources.policy import DEFAULT, Exit
from ledgerguard.sources.tables import contract_tables
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def audit(spark):
    from ledgerguard.session import written
    return written(A.audit_records(spark, contract_tables(spark, SF_SMALL)), "audit-test")


def test_records(spark, audit):
    rows = audit.collect()
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").where("role = 'user'").count()
    assert len(rows) == turns == len({(r.session_id, r.turn) for r in rows})
    for r in rows:
        assert r.outcome in ("answered", "gave_up", "error") and (r.outcome != "answered" or r.intent in ("status", "next_due_date", "invoice_amount", "outstanding_amount"))
        assert r.sql_attempts == len(r.sql_errors) == int(r.intent == "adhoc" and r.outcome != "error")
        nodes = [c.node for c in r.llm_calls]
        assert nodes[0] == "classify_intent" and ("generate_sql" in nodes) == (r.intent == "adhoc") and ("compose_answer" in nodes) == (r.answer is not None)
        assert all(c.payload is None for c in r.llm_calls) and not r.pii_guard_masked
    assert any(r.pii_input for r in rows) and {r.outcome for r in rows} >= {"answered", "gave_up"}


def test_payloads_are_kept_only_if_asked(spark):
    kept = A.audit_records(spark, contract_tables(spark, SF_SMALL), replace(DEFAULT, exit=Exit(keep_payloads=True))).orderBy("session_id", "turn")
    row = kept.limit(1).collect()[0]
    assert row.llm_calls[0].payload == row.question


def test_sink_and_rollup(spark, audit, tmp_path):
    for _ in range(2):  # a run written again is the same run
        A.write_audit(audit, str(tmp_path / "log"), run="a")
    A.write_audit(audit.limit(3), str(tmp_path / "log"), run="b")
    back = spark.read.schema(A.AUDIT_READ_SCHEMA).json(str(tmp_path / "log"))
    assert back.count() == audit.count() + 3
    roll = {r.session_id: r for r in A.audit_rollup(spark.read.schema(A.AUDIT_READ_SCHEMA).json(str(tmp_path / "log" / "run=a"))).collect()}
    rows = audit.collect()
    assert sum(r.turns for r in roll.values()) == len(rows)
    for r in roll.values():
        own = [x for x in rows if x.session_id == r.session_id]
        assert (r.answered, r.gave_up, r.error) == tuple(sum(x.outcome == o for x in own) for o in ("answered", "gave_up", "error"))
        total: dict = {}
        for x in own:
            for k, v in x.pii_input.items():
                total[k] = total.get(k, 0) + v
        assert r.pii_input == ",".join(f"{k}={v}" for k, v in sorted(total.items())) and r.attempts == sum(x.sql_attempts for x in own)


def test_guard_totals_and_calls(spark, audit):
    assert A.guard_totals(audit).count() == 0
    calls = A.call_metadata(audit).collect()
    assert len(calls) == sum(len(r.llm_calls) for r in audit.collect()) and all(len(c.sha256) == 16 and not c.payload_kept for c in calls)
