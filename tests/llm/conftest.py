import pytest


@pytest.fixture
def frame(spark):
    """A one-partition-per-few-rows DataFrame of plain rows."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)

    return make
