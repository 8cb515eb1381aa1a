"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so DATE/TIMESTAMP casts agree with the oracle, AQE for runtime
# re-planning (coalescing, skew-join splitting, broadcast conversion), no web UI.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "ledgerguard", cpus: int | str = "*", shuffle_partitions: int | None = None,
              driver_memory: str = "16g", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benches. On a cluster, build the session with your launcher
    and only apply ``BASE_CONF``; nothing here assumes local mode except ``master``."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.driver.memory"] = driver_memory
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or (8 if cpus == "*" else int(cpus)))
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one. Only a local-mode session without
    that setting (tests, benches) gets a fresh private folder; a cluster session without it is
    an error, since a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/ABFS)")
    folder = tempfile.mkdtemp(prefix="ledgerguard-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, for sinks written by a job."""
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"



SMALL_PART = 32 << 20  # bytes of input for each core below which reading gives too few tasks
TINY = 1 << 20  # bytes of input that are done sooner than dealt


def spread(df, *columns: str):
    """``df`` dealt over all cores by the hash of ``columns``, if its input files are too small for reading to make a task
    for each core: for work that costs much more than reading. Large inputs, whose files give tasks enough, stay as they
    are; so a shuffle here is always a small one. Tiny inputs are left alone too. Only the plan is looked at."""
    if getattr(df, "_jdf", None) is None:  # no classic plan to look at (Spark Connect)
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores, *columns) if TINY < size < cores * SMALL_PART else df


UNKNOWN = 1 << 62  # Spark's estimate of inputs whose size it cannot know is above
GROUPING_PART = 4 << 20  # bytes of columnar input whose nearly distinct keys one task may hold


def by_key(df, *columns: str, part: int | None = None):
    """``df`` dealt by the hash of ``columns`` to as many tasks as its input asks for, before it is grouped by them: where
    nearly each row is a group, a task's memory grows with its rows, so their number grows with the input instead (given
    as a number, it is kept; partitions joined by their compressed size would not be small). Small inputs stay. ``part``:
    bytes of input for a task (``GROUPING_PART``)."""
    part = part or GROUPING_PART
    if getattr(df, "_jdf", None) is None:
        return df
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size >= UNKNOWN:
        return df
    return df.repartition(max(least, -(-size // part)), *columns) if size > 4 * part else df


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What is run inside removes its shuffle files when it ends, instead of leaving them until the driver collects its
    garbage: for writes whose result is read back, so that no more than one job's shuffles lie on the disks."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def written(df, name: str):
    """``df`` written once to the shared folder and read back: evaluated once, lineage cut, safe from lost executors. The
    shuffles behind it are removed."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application, for Python workers that import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "ledgerguard_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
