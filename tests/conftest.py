import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerguard.session import get_spark, checkpoint_dir
    s = get_spark("ledgerguard-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    from tests.fixtures.seed import fixture_tables
    return fixture_tables(spark)
