import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from notelith.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
