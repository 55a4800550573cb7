import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohortspark.session import local_session

    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a Column builder over literal values of one column ``c``."""

    def evaluate(build, values, ddl="c string"):
        df = spark.createDataFrame([(v if isinstance(v, tuple) else (v,)) for v in values], ddl)
        return [r[0] for r in df.select(build("c").alias("out")).collect()]

    return evaluate
