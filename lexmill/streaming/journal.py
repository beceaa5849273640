"""The journal as a stream: running statistics by model over the files that arrive. An extension of the batch statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.journal import SCHEMA


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def usage(stream: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Requests, failures and mean latency by window and model; rows later than `late` are left out."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", window), "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "success").alias("failed"), F.avg("response_time_ms").alias("avg_ms")
    )
