"""Dense numbers over sorted ranges, and tables written to the shared folder."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import numbering
from lexmill.sources import shared


@pytest.mark.parametrize("parts", ["1", "5"])
def test_numbers_are_dense_and_in_order(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(9)]), rng.choice("abc"), i) for i in range(300)] + [(4, "b", 999)] * 200  # a key with many rows
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = numbering.numbered(spark.createDataFrame(rows, "n int, _part string, i int").repartition(3), "n", "_part", name="k", first=7).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found.sort(key=lambda r: r["k"])
    assert [r["k"] for r in found] == list(range(7, 507))
    key = lambda r: (r["n"] is not None, r["n"] or 0, r["_part"])
    assert [key(r) for r in found] == sorted(map(key, found)) and sorted(r["i"] for r in found) == sorted(r[2] for r in rows)


def test_plan_has_no_window(spark, capsys):
    numbering.numbered(spark.range(10).withColumn("x", F.col("id") % 3), "x").explain()
    assert "Window" not in capsys.readouterr().out


def test_empty(spark):
    assert numbering.numbered(spark.range(0), "id").count() == 0


def test_written_tables_are_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "_written", [])
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert shared.written(spark.range(3), "three").count() == 3 and len(list(tmp_path.iterdir())) == 1
    shared.release(spark)
    assert not list(tmp_path.iterdir()) and not shared._written
