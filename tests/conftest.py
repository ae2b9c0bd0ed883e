import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parlance.session import local_session  # noqa: E402

# Columns need a running session, also while test modules are loaded.
SESSION = local_session("4", "tests")
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a Column over one row of named values."""
    from pyspark.sql import functions as F

    def run(column, **values):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
        got = row.select(column.alias("x")).first()[0]
        return got.asDict(recursive=True) if hasattr(got, "asDict") else got

    return run
