"""Using all cores when a table comes in few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it would be read by fewer tasks than there are.

    Meant for costly expressions over a small or badly split input. A large
    input has more splits than cores and is returned as it is: nothing moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
