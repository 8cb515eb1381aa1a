"""Ad-hoc governed queries: what is refused, what a query may see, and that nothing leaves unmasked."""
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerguard.operators import adhoc as AD
from ledgerguard.sources.tables import CONTRACT_TABLES


@pytest.fixture(scope="module")
def tables(seed):
    return {n: seed[n] for n in CONTRACT_TABLES}


@pytest.mark.parametrize("sql, reason", [
    ("DROP VIEW customers", AD.COMMAND), ("SET x = 1", AD.COMMAND), ("CREATE TABLE t AS SELECT 1 AS a", AD.COMMAND),
    ("INSERT INTO contracts SELECT * FROM contracts", AD.COMMAND), ("EXPLAIN SELECT * FROM customers", AD.COMMAND),
    ("SELEC * FROM customers", AD.NOT_PARSED), ("SELECT 1 AS a; SELECT 2 AS b", AD.NOT_PARSED), ("", AD.NOT_PARSED),
    ("SELECT SSN FROM customers", AD.NOT_RESOLVED), ("SELECT * FROM nothing", AD.NOT_RESOLVED), ("SELECT Id FROM contracts WHERE Id = :unbound", AD.NOT_RESOLVED),
    ("SELECT TRANSFORM(Email) USING 'cat' AS (x) FROM customers", AD.UNTRACEABLE),
    ("SELECT reflect('java.lang.System', 'getProperty', 'user.name') AS who", AD.FOREIGN_CODE),
    ("SELECT (SELECT java_method('java.lang.System', 'getProperty', 'user.name') FROM contracts LIMIT 1) AS who", AD.FOREIGN_CODE),
    ("SELECT input_file_name() AS f FROM contracts", AD.FOREIGN_CODE),
    ("SELECT Id, id FROM contracts", AD.SAME_NAMES), ("SELECT a.Id, b.Id FROM contracts a JOIN customers b ON a.Id = b.Id", AD.SAME_NAMES)])
def test_refused(spark, tables, sql, reason):
    got = AD.governed_query(tables, sql, {"as_of_date": date(2026, 1, 1)})
    assert (got.verdict, got.reason, got.rows, got.vault) == (AD.REFUSED, reason, None, None)


def test_a_file_read_by_path_is_refused(spark, tables, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert AD.governed_query(tables, f"SELECT * FROM parquet.`{path}`").reason == AD.UNTRACEABLE
    spark.range(3).createOrReplaceTempView("somebody_elses")
    assert AD.governed_query(tables, "SELECT * FROM somebody_elses").reason == AD.UNTRACEABLE
    spark.catalog.dropTempView("somebody_elses")


def test_views_are_gone_afterwards(spark, tables):
    AD.governed_query(tables, "SELECT Id FROM contracts")
    assert not any(t.name == "contracts" for t in spark.catalog.listTables())


def test_parameters_are_values(tables):
    sql = "SELECT Id, SequenceNumber FROM contracts WHERE SequenceNumber = :seq"
    (known,) = tables["contracts"].select("SequenceNumber").limit(1).collect()
    assert AD.governed_query(tables, sql, {"seq": known[0], "not_used": 5}).rows.count() == 1
    assert AD.governed_query(tables, sql, {"seq": "x' OR '1'='1"}).rows.count() == 0


def test_only_the_given_contracts_are_seen(spark, tables):
    some = tables["contracts"].select(F.col("Id").alias("contract_id")).orderBy("contract_id").limit(2)
    ids = {r[0] for r in some.collect()}
    rows = AD.governed_query(tables, "SELECT contract_id, count(*) AS n FROM receivables GROUP BY contract_id", contracts=some).rows.collect()
    assert {r.contract_id for r in rows} <= ids and rows
    every = AD.governed_query(tables, "SELECT count(*) AS n FROM contracts", contracts=some).rows.first()
    assert every.n == 2


def test_rows_leave_masked_and_come_back_for_the_user(tables):
    sql = "SELECT contract_id, concat(FirstName, ' of ', AddressLine1) AS who, Email, collect_list(Phone) AS lines, 'write to a@b.io' AS remark " \
          "FROM customers GROUP BY contract_id, FirstName, AddressLine1, Email"
    got = AD.governed_query(tables, sql)
    secret = {v for r in tables["customers"].select("Email", "Phone").collect() for v in r if v}
    rows = got.rows.collect()
    assert got.verdict == AD.ANSWERED and rows and set(got.entities) == {"who", "Email", "lines"}
    for r in rows:
        text = " ".join(str(r[c]) for c in ("who", "Email", "lines", "remark"))
        assert not any(s in text for s in secret) and "a@b.io" not in text and r.remark.startswith("write to <EMAIL_")
    numbers = sorted({int(r.Email[7:-1]) for r in rows if r.Email} | {int(r.remark.split("_")[1][:-1]) for r in rows})
    assert numbers == list(range(1, len(numbers) + 1))  # several rows of one session: numbered without a gap
    shown = {r.Email for r in got.shown("Email").collect() if r.Email}
    assert shown == {r[0] for r in tables["customers"].select("Email").collect() if r[0]} & shown and shown


def test_numbers_alone_need_no_vault(tables):
    got = AD.governed_query(tables, "SELECT Id, Amount FROM receivables")
    assert got.rows.count() and got.vault.count() == 0
