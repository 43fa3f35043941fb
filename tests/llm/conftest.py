import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows in a frame of a schema; more partitions than rows are fine."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
