"""Incremental appends as a stream: each new file of rows once, duplicates of a key within the watermark dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def append_new(spark: SparkSession, source: str, schema: StructType, keys: list[str], time: str, target: str, checkpoint: str, late: str = "30 days") -> StreamingQuery:
    """Start a query that takes the files of `source` not yet taken, drops rows whose keys came within `late`, appends Parquet to
    `target` and stops.  A stopped or failed run resumes from its checkpoint."""
    rows = spark.readStream.schema(schema).parquet(source)
    once = dedupe(rows, keys, time, late)
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dedupe(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
