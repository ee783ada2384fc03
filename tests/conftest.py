import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from shelfspark.session import ENGINE_CONF
    b = (SparkSession.builder.master("local[*]").appName("shelfspark-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shelfspark-test-ckpt-")))
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True, scope="module")
def nothing_cached_before(spark):
    """What another file's tests left in the cache would stand in the plans of these."""
    spark.catalog.clearCache()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="shelfspark-test-")
