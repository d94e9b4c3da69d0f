from __future__ import annotations

import pytest

from waybill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, app="waybill-tests")
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture()
def column(spark):
    """Values of a column function over a list of inputs, in order."""
    from pyspark.sql import functions as F

    def run(function, inputs, kind="string"):
        rows = [(i, v) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, x {kind}")
        out = df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
        return [r.y for r in out]

    return run
