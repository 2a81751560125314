import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pivotlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory(prefix="pivotlake-tests-", ignore_cleanup_errors=True) as shared:
        session = build_session(
            "tests",
            "local[8]",
            **{
                "spark.sql.shuffle.partitions": "8",
                "spark.ui.enabled": "false",
                "spark.driver.memory": "6g",
                "spark.checkpoint.dir": shared,
            },
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def nulls5(spark):
    """Five rows with a null group and null measures."""
    return spark.createDataFrame(
        [
            ("N", "Open", 1.0, 1),
            ("N", "Closed", 2.0, 2),
            ("S", "Open", None, 3),
            (None, "Open", 4.0, 4),
            ("S", "Closed", None, 5),
        ],
        "Region string, Status string, Amt double, Q int",
    )


def rows(df):
    return [tuple(r) for r in df.collect()]
