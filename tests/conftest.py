import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pubag import get_session

    s = get_session(master="local[4]", shuffle_partitions=8, app="pubag-tests")
    yield s


@pytest.fixture(scope="session")
def docs(spark):
    from pubag.sources.fixtures import pu_docs

    return pu_docs(spark, SF01).cache()
