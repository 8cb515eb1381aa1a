"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerguard.session import checkpoint_dir, shuffles_removed

# Word separators of every contract in this subpackage: space and the control characters 0x09 to 0x0D.
SEPARATORS = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below spark.checkpoint.dir and read it back.

    The written table cuts the lineage and survives lost executors; every reader sees the same rows. The shuffles
    behind it are read by nobody from then on and are removed.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body`` (a let-expression)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows round-robin over as many tasks as shuffles use, for tables of few but costly rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application, so that their Python workers
    can import it (and keep module-level state such as tokenizer caches from task to task)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "ledgerguard_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def gives_back(run):
    """``run``; at its end the worker, which lives on for other tasks, gives back the memory that Arrow keeps for later."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return whole


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package's code at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(gives_back(run), schema)


HOT_SHARE = 1000  # a key with more than 1/HOT_SHARE of all rows is hot, so at most HOT_SHARE keys are


def heavy_light_join(rows: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """``rows`` left-joined with ``values`` (one row for each ``key``) without any key's rows meeting in one task.

    Values of hot keys (at most HOT_SHARE, by a count of all rows) are broadcast. The other keys are joined
    by a shuffle; rows already served, or without a key, go there under salted keys that match nothing.
    """
    total = rows.count()
    hot_keys = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") * HOT_SHARE > total).select(key)
    marked = values.join(F.broadcast(hot_keys.withColumn("__hot", F.lit(True))), key, "left")
    marked = materialize(marked.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.coalesce("__hot", F.lit(False)).alias("__hot")), "values")
    hot = F.broadcast(marked.where("__hot").select(F.col("__k").alias("__hk"), F.col("__v").alias("__hv")))
    cold = marked.where("not __hot").select("__k", F.col("__v").alias("__cv"), F.lit(0).alias("__s"))
    first = rows.join(hot, F.col(key) == F.col("__hk"), "left")
    served = F.col("__hk").isNotNull() | F.col(key).isNull()
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(HOT_SHARE)).cast("int") + 1
    first = first.withColumn("__salt", F.when(served, salt).otherwise(F.lit(0)))
    both = first.join(cold, (F.col(key) == F.col("__k")) & (F.col("__salt") == F.col("__s")), "left")
    return both.withColumn(value, F.coalesce("__hv", "__cv")).drop("__hk", "__hv", "__k", "__cv", "__s", "__salt")
