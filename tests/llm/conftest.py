import pytest


@pytest.fixture(scope="session", autouse=True)
def pii_key(spark):
    """Runs of the tests agree."""
    spark.conf.set("spark.probelens.pii.key", "tests")
