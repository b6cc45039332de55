"""Batch-stamped tables: what a micro-batch writes can be written again without doubling rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_batches(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The table, or its rows from batches earlier than ``before`` (folders are pruned)."""
    layout = f"{_ddl(schema)}, batch_id long"
    try:
        table = spark.read.schema(layout).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], layout)
    return table if before is None else table.filter(F.col("batch_id") < before)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Replace the folder of one batch, so that a repeated batch leaves the same rows."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
