import pytest
from pyspark.sql import functions as F

from ledgerguard.operators.lineage import classify_output
from ledgerguard.operators.scope import contract_scope, out_of_scope_rows
from ledgerguard.sources.tables import CONTRACT_TABLES, register_views

TABLES = set(CONTRACT_TABLES)
CASES = [
    ("SELECT Zip AS area, Id FROM customers", {"area": "ZIP"}),
    ("SELECT trim(LastName) AS n FROM (SELECT LastName FROM customers WHERE SSN IS NOT NULL)", {"n": "PERSON"}),
    ("WITH w AS (SELECT Phone AS a, Id FROM customers) SELECT x.a, y.Id FROM w x JOIN w y ON x.a = y.a", {"a": "PHONE"}),
    ("SELECT customers.Email AS e FROM (SELECT SSN AS Email FROM customers) customers", {"e": "SSN"}),
    ("SELECT v FROM customers UNPIVOT (v FOR c IN (SSN, Email))", {"v": "SSN"}),
    ("SELECT Email FROM customers GROUP BY CUBE(Email)", {"Email": "EMAIL"}),
    ("SELECT FirstName AS a FROM customers UNION SELECT SSN FROM customers", {"a": "SSN"}),
    ("SELECT w FROM customers LATERAL VIEW explode(split(AddressLine1, ' ')) t AS w", {"w": "ADDRESS"}),
    ("SELECT Status, (SELECT max(SSN) FROM customers) AS s FROM contracts", {"s": "SSN"}),
    ("SELECT WorkflowStatus, count(*) AS n FROM contracts GROUP BY WorkflowStatus", {}),
    ("SELECT rank() OVER (ORDER BY Email) AS r FROM customers", {"r": "EMAIL"}),
]


@pytest.mark.parametrize("sql, expected", CASES)
def test_lineage(spark, seed, sql, expected):
    register_views(seed)
    assert classify_output(spark.sql(sql), tables=TABLES) == expected


def test_untraceable_queries_give_none(spark, seed):
    register_views(seed)
    assert classify_output(seed["customers"]) is None  # not a view: nothing is known about its columns
    assert classify_output(spark.sql("SELECT Status FROM contracts")) is None  # a view nobody vouched for
    assert classify_output(spark.table("customers").mapInPandas(lambda x: x, "a string"), tables=TABLES) is None


def test_scoped_views_only_hold_rows_of_their_contract(seed):
    sc = contract_scope(seed)
    assert "SSN" not in sc["customers"].columns
    cu = {(r.contract_id, r.FirstName) for r in sc["customers"].collect()}
    assert (1, "Wanda") in cu and (4, "Wanda") in cu and len(cu) == 12
    r = sc["receivables"].collect()
    assert all(x.EntityType == "CT" and x.contract_id == x.EntityId for x in r)
    pi = {(x.contract_id, x.Id) for x in sc["payableinvoices"].collect()}
    assert pi == {(1, 1), (2, 2), (5, 3), (6, 4), (6, 5), (6, 6), (9, 7), (11, 8)}


def test_sundry_rows_are_out_of_scope(seed):
    out = {(r.TableName, r.RowKey.split("|")[0]) for r in out_of_scope_rows(seed).collect()}
    assert ("receivables", "68") in out and ("receivables", "69") in out
    assert ("receivabledetails", "68") in out and len(out) == 4
