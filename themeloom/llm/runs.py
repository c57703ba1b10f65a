"""Documents packed into runs of some megabytes, stored so that they need not be shuffled.

A run is one row with all its documents. The table is bucketed by run, so small
tables about runs can be brought to it any number of times while it stays put.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import text_or_empty
from themeloom.plans.lineage import scratch_path

RUN_BYTES = 2_000_000
NO_ID = np.iinfo(np.int64).max  # stands for a null id: smaller than none

RUN = "run long, ids array<long>, ends array<long>, data binary"


def pack(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents packed into rows of about RUN_BYTES: ids, ends of their bytes, all bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends, parts, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            name = int.from_bytes(os.urandom(8), "big") >> 1
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())),
                 pa.array([b"".join(parts)], pa.binary())],
                ["run", "ids", "ends", "data"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                ids.append(batch.column(0)[i].as_py())
                parts.append(data)
                size += len(data)
                ends.append(size)
                if size >= RUN_BYTES:
                    yield row()
                    ids, ends, parts, size = [], [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.encode(text_or_empty(text), "UTF-8").alias("b"))
    return rows.mapInArrow(run, RUN)


def bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` as a table in the shared folder, bucketed by run."""
    spark = rows.sparkSession
    name = f"runs_{uuid.uuid4().hex}"
    path = scratch_path(spark, "runs")
    rows.write.format("parquet").bucketBy(buckets, "run").option("path", path).saveAsTable(name)
    return spark.table(name)


def row_arrays(batch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    ids = batch.column("ids")[i].as_py()
    known = np.array([NO_ID if x is None else x for x in ids], np.int64)
    ends = np.array(batch.column("ends")[i].as_py(), np.int64)
    return np.frombuffer(batch.column("data")[i].as_py(), np.uint8), ends, known, ids
