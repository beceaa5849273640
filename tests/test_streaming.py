"""The stream of answers against the batch, in any order of files, with restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lexmill.operators import answers as A
from lexmill.streaming import answers as stream


def made(rng, n):
    start = dt.datetime(2024, 1, 1)
    return [(rng.choice(["a", "b", "c", "d", None]), "q", rng.choice(["x", "y", "z"]), None, start + dt.timedelta(minutes=rng.randint(0, 300)) if rng.random() > 0.05 else None) for _ in range(n)]


def test_any_order_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = made(rng, 120)
    want = sorted(tuple(r) for r in stream.as_batch(spark.createDataFrame(rows, A.CACHE)).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for order in range(2):
            rng.shuffle(rows)
            files, path = tmp_path / f"in{order}", tmp_path / f"cache{order}"
            cache = A.Cache(spark, str(path))
            for start in range(2):  # the second start goes on where the first has stopped, with more files and some that repeat events
                part = rows[:60] if not start else rows[60:] + rows[:7]
                for at in range(0, len(part), 40):
                    spark.createDataFrame(part[at : at + 40], A.CACHE).coalesce(1).write.mode("append").parquet(str(files))
                read = spark.readStream.schema(A.CACHE).option("maxFilesPerTrigger", 1).parquet(str(files))
                stream.into_cache(read, cache, str(tmp_path / f"at{order}")).trigger(availableNow=True).start().awaitTermination()
            assert sorted(tuple(r) for r in cache.rows().collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_late_events_are_dropped(spark, tmp_path):
    files, cache = str(tmp_path / "in"), A.Cache(spark, str(tmp_path / "cache"))
    at = lambda hour: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)
    for key, answer, hour in (("a", "first", 1), ("b", "moves the time on", 100), ("a", "late", 2), ("c", "in time", 90)):
        spark.createDataFrame([(key, "q", answer, None, at(hour))], A.CACHE).coalesce(1).write.mode("append").parquet(files)
        read = spark.readStream.schema(A.CACHE).parquet(files)
        stream.into_cache(read, cache, str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert {(r["query_hash"], r["answer"]) for r in cache.rows().select(F.col("query_hash"), "answer").collect()} == {("a", "first"), ("b", "moves the time on"), ("c", "in time")}
