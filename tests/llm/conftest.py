import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    from odd_rows import EXTRA, ROWS, SCHEMA
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="session")
def empty(spark):
    from odd_rows import SCHEMA

    return spark.createDataFrame([], SCHEMA)
