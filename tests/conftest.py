import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from parkops.session import SESSION_CONF
    b = (SparkSession.builder.master("local[4]").appName("parkops-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="parkops-test-wh-")))
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parkops-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from parkops.plans.check import duck
    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def garage(spark):
    from parkops.sources.views import Garage
    return Garage(spark, SF_MID)
