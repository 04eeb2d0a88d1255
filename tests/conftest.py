import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from raresift.session import local_session

    session = local_session("8", app="tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from raresift.plans.analogues import Tables

    return Tables(spark, "/root/testdata/sf0.001")
