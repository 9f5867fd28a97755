import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
FIX = os.path.join(ROOT, "tests", "fixtures")
SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from qsumm.session import ensure_checkpoint_dir, ship_package
    spark = (SparkSession.builder.master("local[*]").appName("qsumm-tests")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="qsumm-test-ckpt-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    yield spark
    spark.stop()


@pytest.fixture()
def fix():
    return lambda *p: os.path.join(FIX, *p)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="qsumm-test-out-")
