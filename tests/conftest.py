import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tastemill.session import get_spark
    s = get_spark("local[4]", app="tastemill-tests", shuffle_partitions=4,
                  extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
