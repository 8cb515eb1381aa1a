from pyspark.sql import functions as F

from ledgerguard.operators import quality as Q


def test_clean_fixture_has_no_violations(seed):
    assert Q.run_checks(seed).count() == 0


def test_each_check_fires_on_a_broken_copy(seed):
    m = Q.mutated_tables(seed)
    got = {r.Check for r in Q.run_checks(m).collect()}
    assert {"paid_balance", "rollup_mismatch", "finance_type", "enum"} <= got


def test_foreign_keys_and_orphans(spark, seed):
    t = dict(seed)
    extra = spark.createDataFrame([(999, 999)], t["leasefundings"].schema)
    t["leasefundings"] = t["leasefundings"].unionByName(extra)
    rows = Q.dq_foreign_keys(t).collect()
    assert {(r.TableName, r.Detail.split("=")[0]) for r in rows} == {
        ("leasefundings", "LeaseFinanceId->leasefinances.Id"), ("leasefundings", "PayableInvoiceId->payableinvoices.Id")}
    dup = t["contracts"].unionByName(t["contracts"].where(F.col("Id") == 1))
    t["contracts"] = dup
    keys = {(r.Check, r.TableName, r.RowKey) for r in Q.dq_keys(t).collect()}
    assert ("duplicate_key", "contracts", "1") in keys and ("duplicate_key", "contracts", "CT-1001") in keys


POLICY = """entity_types: {PERSON: {reveal_to_user: true}, SSN: {reveal_to_user: false}}
columns: {Customers.FirstName: PERSON, Customers.SSN: SSN}
detectors: {regex: [%s], known_values: {enabled: true, min_length: 5}}
allow_list: {terms: [Lease], patterns: ['CT-\\d+']}
egress_guard: {mode: %s}
"""


def test_policy_file(spark, tmp_path):
    import pytest
    from ledgerguard.sources.policy import DEFAULT, PolicyError, load_policy
    file = tmp_path / "p.yaml"
    file.write_text(POLICY % ("SSN, EMAIL", "block"))
    p = load_policy(str(file))
    assert p.shown == {"PERSON": True, "SSN": False} and p.columns[("customers", "ssn")] == "SSN"
    assert p.detectors.regex == ("SSN", "EMAIL") and p.detectors.shortest_known == 5 and p.exit.mode == "block"
    assert p.detectors.name_score == DEFAULT.detectors.name_score and p.never_selected == DEFAULT.never_selected  # left out: defaults
    words = spark.createDataFrame([("CT-1001",), (" lease ",), ("John",), ("xCT-1",)], "w string")
    assert [r.ok for r in words.select(p.allows(F.col("w")).alias("ok")).collect()] == [True, True, False, False]
    file.write_text((POLICY % ("SSN, PASSPORT", "shout")).replace("FirstName: PERSON", "FirstName: FRIEND"))
    with pytest.raises(PolicyError) as err:
        load_policy(str(file))
    assert all(x in str(err.value) for x in ("PASSPORT", "shout", "FRIEND"))
    file.write_text("{}")
    assert load_policy(str(file)) == DEFAULT


def test_policy_reaches_the_operators(spark):
    from dataclasses import replace
    from ledgerguard.operators import masking as M
    from ledgerguard.sources.policy import DEFAULT, Detectors
    texts = spark.createDataFrame([(1, "s", "Ann Smith, ann@corp.example.org, 900-12-3456")], "id int, session_id string, t string")
    kv = spark.createDataFrame([("s", "ann smith", "Ann Smith", "PERSON")], "session_id string, norm string, value string, entity string")

    def masked(policy):
        return M.mask_text(texts, "t", ["id"], known_values=kv, policy=policy).cells.collect()[0].masked
    assert masked(DEFAULT) == "<PERSON_1>, <EMAIL_1>, <SSN_1>"
    assert masked(replace(DEFAULT, detectors=Detectors(regex=("SSN",)))) == "<PERSON_1>, ann@corp.example.org, <SSN_1>"
    assert masked(replace(DEFAULT, detectors=Detectors(known_values=False, regex=()))) == "Ann Smith, ann@corp.example.org, 900-12-3456"
    assert masked(replace(DEFAULT, never_masked=("ann smith",))) == "Ann Smith, <EMAIL_1>, <SSN_1>"
    m = M.mask_text(texts, "t", ["id"], known_values=kv)
    hidden = replace(DEFAULT, shown={**DEFAULT.shown, "PERSON": False})
    assert M.unmask(m.cells, "masked", ["id"], m.vault, policy=hidden).collect()[0].unmasked == "[REDACTED], ann@corp.example.org, [REDACTED]"

