import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridweave.session import session

    return session("tests", os.environ.get("TEST_CPUS", "8"))


@pytest.fixture
def small_chunks(spark):
    """Force chunking on small inputs."""
    spark.conf.set("gridweave.rowsPerChunk", "50")
    yield spark
    spark.conf.unset("gridweave.rowsPerChunk")
