import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from policyflow.session import build_session

    session = build_session(
        "tests", "local[8]",
        {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Small frame from tuples and a DDL schema."""
    quoted = lambda schema: ", ".join("`%s` %s" % tuple(part.split()) for part in schema.split(", "))
    return lambda data, schema: spark.createDataFrame(data, quoted(schema))
