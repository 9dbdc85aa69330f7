"""Cutting the lineage of iterated plans, by tables in the shared folder of the session, and sums of arrays over tasks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of arrays of doubles, as bytes, by number.
PACKED = "id int, body binary"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the folder of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        shared = tempfile.mkdtemp(prefix="spark-")
    path = f"{shared.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed_rows(arrays: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"id": pa.array(list(arrays), pa.int32()), "body": pa.array([v.astype(np.float64).tobytes() for v in arrays.values()], pa.binary())})


def packed_sums(parts: DataFrame) -> dict[int, np.ndarray]:
    """Arrays of doubles added up by number; one row a number reaches the driver."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table["body"].to_pylist())
        return pa.table({"id": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([total.tobytes()], pa.binary())})

    return {r["id"]: np.frombuffer(r["body"], np.float64) for r in parts.groupBy("id").applyInArrow(add, PACKED).collect()}
