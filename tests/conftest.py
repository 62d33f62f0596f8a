import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tallymark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def values(spark):
    """Evaluate a column expression over a list of texts."""

    def run(make, texts, schema="x STRING"):
        rows = [t if isinstance(t, tuple) else (t,) for t in texts]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i INT, {schema}")
        return [r.y for r in df.select("i", make().alias("y")).orderBy("i").collect()]

    return run
