import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="8", shuffle_partitions=2)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def one(spark):
    """Evaluate one expression over literal columns."""

    def run(build, **values):
        schema = ", ".join(f"{name} {kind}" for name, (kind, _) in values.items())
        row = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
        return row.select(build.alias("out")).first()["out"]

    return run
