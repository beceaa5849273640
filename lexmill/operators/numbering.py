"""Dense numbers in an order over all rows, without a window that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Spark's row numbers have the task above so many bits.
_INSIDE = 33


def numbered(rows: DataFrame, *order: str, name: str = "number", first: int = 0) -> DataFrame:
    """Adds name: first, first + 1 and on, by the order's columns, nulls first; rows that are equal in it are numbered in any order.

    Rows are sorted over ranges and written with their place in their range; only the ranges' counts are added up, on the driver, one number a task."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.select(F.struct("*").alias("_row"), *order, F.monotonically_increasing_id().alias("_salt"))  # equal rows may lie in several ranges
    ranged = salted.repartitionByRange(parts, *order, "_salt").sortWithinPartitions(*order)
    placed = written(ranged.select("_row", F.monotonically_increasing_id().alias("_at")), "numbered")
    part = F.shiftright("_at", _INSIDE)
    starts, total = [], first
    for r in sorted(placed.groupBy(part.alias("_part")).count().collect()):
        starts.append((r["_part"], total))
        total += r["count"]
    known = spark.createDataFrame(starts, "_part long, _start long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << _INSIDE) - 1))
    found = placed.withColumn("_part", part).join(F.broadcast(known), "_part")
    return found.select("_row.*", (F.col("_start") + inside).alias(name))
