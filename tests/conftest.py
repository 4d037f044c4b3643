import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from encore.session import tune

    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def retail(spark):
    """Canonical tables of the smallest test data, stored once for all tests."""
    from encore.plans.catalog import Retail

    tables = Retail(spark, SF_DIR, store=True)
    for name in ("orders", "accu_orders", "purchases", "accu_history", "tables"):
        getattr(tables, name)
    return tables
