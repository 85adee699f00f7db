import pytest


@pytest.fixture
def frame(spark):
    """frame(rows): documents (doc_id, text, extra columns with names that operators use inside)."""
    return lambda rows, schema="doc_id long, text string": spark.createDataFrame(rows, schema)
