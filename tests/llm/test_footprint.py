"""What a finished job leaves behind on the disks and in the workers."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerguard.llm import common
from ledgerguard.session import CLEANUP, written


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffles_of_a_written_table_are_removed(spark):
    for write in (common.materialize, written):
        before, set_ = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
        out = write(spark.range(2000).groupBy((F.col("id") % 7).alias("k")).count(), "left-behind")
        until = time.time() + 20
        while _shuffle_files(spark) - before and time.time() < until:  # they are removed behind the caller's back
            time.sleep(0.2)
        assert not _shuffle_files(spark) - before
        assert {r["k"] for r in out.collect()} == set(range(7))
        assert spark.conf.get(CLEANUP, None) == set_


def test_workers_give_arrow_memory_back_at_the_end_of_a_task(monkeypatch):
    given = []

    class Pool:
        def release_unused(self):
            given.append(True)

    monkeypatch.setattr(pa, "default_memory_pool", lambda: Pool())
    out = common.gives_back(lambda batches: (b for b in batches))(iter([1, 2]))
    assert next(out) == 1 and not given
    assert list(out) == [2] and given
