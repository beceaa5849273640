"""The interactions journal: statistics, recent rows, append and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import error_message, present, stored_text
from ..sources.corpus import exists

_L, _S, _I = T.LongType(), T.StringType(), T.IntegerType()
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("id", _L), ("created_at", T.TimestampType()), ("query", _S), ("response", _S), ("from_cache", T.BooleanType()), ("response_time_ms", _I),
        ("model", _S), ("top_k", _I), ("sources_count", _I), ("status", _S), ("error_message", _S), ("interface", _S),
    )]
)
#: Models listed in statistics.
MODELS = 10


def stats(journal: DataFrame) -> DataFrame:
    """One pass: totals, cache hit rate over all rows, mean and largest latency of all statuses."""
    n = F.count(F.lit(1))
    return journal.agg(
        n.alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") != "success").alias("failed"),
        F.count_if("from_cache").alias("cache_hits"), F.when(n == 0, 0.0).otherwise(F.count_if("from_cache") / n).alias("hit_rate"),
        F.round(F.avg("response_time_ms"), 2).alias("avg_ms"), F.max("response_time_ms").alias("max_ms"),
    )


def models(journal: DataFrame, most: int = MODELS) -> DataFrame:
    return journal.groupBy("model").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("model")).limit(most)


def recent(journal: DataFrame, n: int = 10) -> DataFrame:
    """The last n rows, without texts; blank names are shown as a dash."""
    dash = lambda c: F.coalesce(present(F.col(c)), F.lit("—")).alias(c)
    return journal.orderBy(F.desc("id")).limit(n).select("id", "created_at", "status", "from_cache", "response_time_ms", dash("model"), dash("interface"))


def numbered(rows: DataFrame, last: int = 0) -> DataFrame:
    """Adds number: last + 1 and on, by time and query.

    Rows are numbered inside their minute, and minutes start where the ones before end: only counts meet in one task."""
    timed = rows.withColumn("_minute", F.date_trunc("minute", "created_at"))
    ahead = Window.orderBy(F.asc_nulls_first("_minute")).rowsBetween(Window.unboundedPreceding, -1)
    starts = timed.groupBy("_minute").agg(F.count(F.lit(1)).alias("_n")).select("_minute", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_minute").orderBy("created_at", "query"))
    placed = timed.withColumn("_inside", inside).alias("t").join(starts.alias("s"), F.expr("t._minute <=> s._minute"))
    return placed.withColumn("number", (F.col("_start") + F.col("_inside") + F.lit(last)).cast("long")).select("t.*", "number").drop("_minute", "_inside")


def append(spark: SparkSession, rows: DataFrame, path: str, store_text: bool = False) -> None:
    """Number new rows after the largest id there is (one writer at a time) and add them."""
    last = spark.read.schema(SCHEMA).parquet(path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if exists(spark, path) else 0
    ready = numbered(rows, last).withColumns({
        "id": F.col("number"), "query": stored_text(F.col("query"), store_text, F.lit("")), "response": stored_text(F.col("response"), store_text, F.lit(None).cast("string")),
        "error_message": error_message(F.col("error_message")),
    })
    ready.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields]).write.mode("append").parquet(path)


def export_csv(journal: DataFrame, path: str) -> None:
    """Parts sorted by range of id, each with a header: in the order of their names they are the journal."""
    journal.select(*SCHEMA.names).orderBy("id").write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
