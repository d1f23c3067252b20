import pytest

from citesift.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("citesift-tests", cpus="4", memory="6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def rows(spark):
    """``rows([(..), ..], "a string, b int")``: a small table."""

    def build(data, schema):
        return spark.createDataFrame(data, schema)

    return build
