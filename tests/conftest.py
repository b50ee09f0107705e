import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from veritable import ROW_ID, Dataset, build_session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """A dataset from rows in order, numbered from 0."""

    def build(rows, schema, name="dataset"):
        numbered = [(*row, i) for i, row in enumerate(rows)]
        return Dataset.of(spark.createDataFrame(numbered, f"{schema}, {ROW_ID} long"), name=name)

    return build
