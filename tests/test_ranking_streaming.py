from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerguard.plans.ranking import rank_within
from tests.conftest import SF_SMALL


def test_rank_within_hot_key_matches_row_number(spark):
    df = spark.range(0, 20000).select((F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50)).alias("k"),
                                      (F.col("id") * 7919 % 20011).alias("o"))
    got = rank_within(df, ["k"], ["o"], out="r", partitions=16)
    exp = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    assert got.select("k", "o", "r").exceptAll(exp.select("k", "o", "r")).count() == 0
    assert got.count() == 20000


def test_rank_within_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 1)], "k string, o int")
    assert sorted((str(r.k), r.o, r.r) for r in rank_within(df, ["k"], ["o"], out="r").collect()) == [
        ("None", 1, 1), ("None", 3, 2), ("a", 1, 1), ("a", 2, 2)]


def test_stream_vault_ttl_fails_closed(spark):
    from ledgerguard.streaming import pipeline as SP
    rows = spark.read.parquet(SP.stream_vault(spark, SF_SMALL)).collect()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r.conv_id, []).append((r.turn, r.status))
    for conv, turns in by_conv.items():
        turns.sort()
        if conv % 4 in (0, 1):      # 25/50 min between turns: never idle past the hour
            assert all(s == "ok" for _, s in turns)
        elif len(turns) > 1:        # 75/100 min between turns: the second use fails closed
            assert turns[0][1] == "ok" and all(s == "error" for _, s in turns[1:])


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "OutstandingTotal" in df.columns
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 90
