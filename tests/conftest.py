import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import database, local_session  # noqa: E402


# Column expressions at module level need a session.
SESSION = local_session("4")
SESSION.conf.set("spark.sql.shuffle.partitions", "3")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def con():
    return database("/root/testdata/sf0.001")


@pytest.fixture
def frame(spark):
    """Build a DataFrame from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def values(spark):
    """Evaluate a column expression over a list of values of one column ``x``."""

    def run(expression, xs, kind):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return run


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
