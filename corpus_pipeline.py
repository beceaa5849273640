"""A corpus pipeline: quality rules, language ID, near-dedup, packing. Counts as part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import written
from lexmill.llm.langid import langid_stage
from lexmill.llm.nearcopies import near_copies_stage
from lexmill.llm.packing import packing_stage
from lexmill.llm.quality import quality_stage

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [("quality", quality_stage), ("language", langid_stage), ("near_dedup", near_copies_stage), ("packing", packing_stage)]

#: Language ID and packing by a public vocabulary can't be written in SQL; tests/llm/test_pipeline.py holds run() against a plain chain of the four stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
