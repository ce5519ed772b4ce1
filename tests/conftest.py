import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from inkfold.session import build_session  # noqa: E402

TESTDATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "inkfold-tests",
        master="local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": 8,
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(TESTDATA):
        pytest.skip(f"no test tables in {TESTDATA}")
    return TESTDATA


@pytest.fixture
def evaluate(spark):
    """Values of a column function over texts, in their order."""

    def run(function, values, ddl="STRING"):
        rows = [(i, value) for i, value in enumerate(values)]
        frame = spark.createDataFrame(rows, f"i INT, v {ddl}")
        from pyspark.sql import functions as F

        found = frame.select("i", function(F.col("v")).alias("r")).collect()
        return [row["r"] for row in sorted(found, key=lambda row: row["i"])]

    return run
