"""Row numbering within groups that stays distributed when one group holds most of the rows.

``row_number() OVER (PARTITION BY keys ORDER BY order)`` puts a whole group into one task. That is what groups of up to
``HOT`` rows get. The rows are written once (evaluated once, and pinned) and rows counted per group; the rows of larger
groups are range-partitioned on (keys, order), sorted within partitions, tagged with their partition id and their index
inside the partition, and written again to pin the tags. Rows per (key, partition) give offsets, by a window over at most
``#partitions`` rows per key, to which the local index is added: a hot key simply spans several consecutive partitions.
Null keys form groups like any other.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerguard.session import written

HOT = 200_000  # rows of a group that one task may sort


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the keys appear once, from the left."""
    renamed = right.select(*[F.col(c).alias(f"__right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str = "rank",
                partitions: int | None = None, hot: int = HOT) -> DataFrame:
    """Dense 1-based numbering of rows within ``keys`` by ``order`` (order values must be unique per key)."""
    rows = written(df, "to-rank")
    small = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).drop("_n")
    if large.isEmpty():
        return rows.withColumn(out, small)
    large = written(large, "hot-keys")
    return (null_safe_join(rows, large, keys, "left_anti").withColumn(out, small)
            .unionByName(_rank_large(null_safe_join(rows, large, keys, "left_semi"), keys, order, out, partitions)))


def _rank_large(df: DataFrame, keys: list[str], order: list[str], out: str, partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*keys, *order]
    tagged = written(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
                     .withColumn("_pid", F.spark_partition_id())
                     .withColumn("_idx", F.monotonically_increasing_id()), "ranked")
    stats = tagged.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_idx").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    return (null_safe_join(tagged, stats.drop("_cnt"), [*keys, "_pid"])
            .withColumn(out, (F.col("_before") + F.col("_idx") - F.col("_first") + 1).cast("long"))
            .drop("_pid", "_idx", "_first", "_before"))
