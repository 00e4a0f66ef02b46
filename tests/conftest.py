import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cadence.session import get_spark

    ck = tempfile.mkdtemp(prefix="cadence-test-ckpt-")
    s = get_spark("local[4]", app_name="cadence-tests", shuffle_partitions=4,
                  extra_conf={"spark.checkpoint.dir": ck, "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    SparkSession.getActiveSession() and s.stop()
