import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from phenoweave import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        master="local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples, doubles rounded."""

    def normal(value):
        return round(value, 9) if isinstance(value, float) else value

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(normal(v) for v in r) for r in picked.collect()), key=repr)

    return collect
