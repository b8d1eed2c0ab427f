import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from isopleth.session import local_session

    session = local_session(cores=8, shuffle_partitions=8, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def many_chunks(spark):
    """Small inputs spread over all shuffle partitions, as large ones do."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, "true")


@pytest.fixture(params=["chunks", "coalesced"])
def both_ways(request, spark):
    """Once with series split into chunks and once with small partitions put together."""
    return request.getfixturevalue("many_chunks") if request.param == "chunks" else spark
