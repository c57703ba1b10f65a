import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def table(spark):
    """Rows as a DataFrame with extra columns whose names the operators use inside."""

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        for name in ("k", "fp", "h", "norm", "unit", "row", "whole", "range", "run", "bucket", "_key"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
