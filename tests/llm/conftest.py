import pytest


@pytest.fixture(scope="module", autouse=True)
def fresh(spark):
    """Python workers keep tables between tests; batches stay small."""
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
