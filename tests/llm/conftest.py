import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from odd_rows import ROWS, SCHEMA  # noqa: E402


def rows_of(rows):
    return [(i, t, g, *["clash"] * (len(SCHEMA) - 3)) for i, t, g in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(ROWS), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 0, 0), (2, 0, 0), (3, 1, 0), (5, 1, 0), (7, 1, 0), (10, 0, 1), (8, None, None), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
