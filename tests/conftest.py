import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vec(spark):
    def make(rows, labels=None):
        data = [(i, [float(v) for v in r]) + ((labels[i],) if labels else ()) for i, r in enumerate(rows)]
        schema = "id long, features array<double>" + (", label int" if labels else "")
        return spark.createDataFrame(data, schema)

    return make
