import pytest

from postbag.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a column function on one Python value."""
    from pyspark.sql import functions as F

    def run(function, arg, type_="string"):
        row = spark.createDataFrame([(arg,)], f"x {type_}").select(function(F.col("x")).alias("y"))
        return row.first()["y"]

    return run
