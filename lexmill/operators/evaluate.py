"""Quality scores: means that skip missing and NaN values, and bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(score: Column) -> Column:
    return F.when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("poor")


def means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """The mean of each metric and the mean of these; 0 where nothing was measured."""
    each = rows.agg(*[F.avg(F.when(~F.isnan(F.col(m).cast("double")), F.col(m))).alias(m) for m in metrics])
    found = reduce(lambda a, b: a + b, [F.col(m).isNotNull().cast("int") for m in metrics])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(m), F.lit(0.0)) for m in metrics])
    return each.select(*[F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics], F.when(found == 0, 0.0).otherwise(total / found).alias("overall"))


def first_match(hits: DataFrame, expected: DataFrame, keys: list[str], query: str = "query_id", rank: str = "rank") -> DataFrame:
    """(query, rank) of each query's first hit that agrees with one of its alternatives, null if none does.

    expected has a row for each alternative; a key that is null in it may be anything.
    """
    agrees = reduce(lambda a, b: a & b, [F.col(f"e.{k}").isNull() | F.col(f"e.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys])
    met = expected.alias("e").join(hits.alias("h"), (F.col(f"e.{query}") == F.col(f"h.{query}")) & agrees, "left")
    return met.groupBy(F.col(f"e.{query}").alias(query)).agg(F.min(f"h.{rank}").alias(rank))


def with_truth(questions: Column, truths: Column) -> Column:
    """Questions and reference answers by position, an array of structs; lists of other lengths are an error."""
    zipped = F.arrays_zip(questions.alias("question"), truths.alias("ground_truth"))
    return F.when(F.size(questions) == F.size(truths), zipped).otherwise(F.raise_error(F.lit("as many reference answers as questions are needed")))


def margin(best: DataFrame) -> DataFrame:
    """The worst best distance of questions in scope and the best of those out of scope: a gate between them tells all apart."""
    return best.agg(F.max(F.when(F.col("in_scope"), F.col("best_distance"))).alias("worst_in_scope"), F.min(F.when(~F.col("in_scope"), F.col("best_distance"))).alias("best_out_of_scope"))
