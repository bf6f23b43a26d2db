import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def pytest_configure(config):
    """Start the session before test modules build column expressions at import."""
    from pyspark.sql import SparkSession

    from corpuslake.session import apply_settings

    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    apply_settings(session)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.active()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row of named strings."""
    def value(column, **fields):
        names = list(fields) or ["t"]
        row = tuple(fields.values()) if fields else ("",)
        schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}"
                           for n, v in zip(names, row))
        return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]

    return value
