"""Duplicates in context: exact ones by normalised text, near ones in order of rank."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text

#: Least length for a near-duplicate, and least ratio.
MIN_CHARS, MIN_RATIO = 40, 0.92


def exact(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each normalised text, by id (null ids last); blank texts all stay.

    Rows are ranked within the 256-bit hash of their normal form; Spark keeps one row of each group before the shuffle, so a hot group is
    one row per task. Repeated ids don't matter, as rows are what is kept. Blank texts have a key of their own each and don't meet.
    """
    norm = normalize_text(F.coalesce(F.col(text), F.lit("")))
    alone = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    keyed = docs.withColumn("_key", F.when(norm != "", F.sha2(norm, 256)).otherwise(alone))
    first = F.row_number().over(Window.partitionBy("_key").orderBy(F.asc_nulls_last(id)))
    return keyed.withColumn("_first", first).filter("_first = 1").drop("_key", "_first")


def _keep(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    kept: list[str] = []
    rows = []
    for i, text in enumerate(pdf.sort_values("rank")["norm"]):
        if text:
            near = len(text) >= MIN_CHARS and any(len(k) >= MIN_CHARS and alike(text, k) for k in kept)
            if text in kept or near:
                continue
            kept.append(text)
        rows.append(i)
        if len(rows) >= most:
            break
    out = pdf.sort_values("rank").iloc[rows].drop(columns="norm")
    return out.assign(kept_rank=range(1, len(out) + 1))


def alike(text: str, kept: str) -> bool:
    """Matching-block ratio, candidate first. The bounds by length and by common characters are sound: no ratio can exceed them."""
    size = len(text) + len(kept)
    if 2 * min(len(text), len(kept)) / size < MIN_RATIO or 2 * (Counter(text) & Counter(kept)).total() / size < MIN_RATIO:
        return False
    return SequenceMatcher(None, text, kept).ratio() >= MIN_RATIO


def context(hits: DataFrame, most: int, query: str = "query_id", text: str = "text") -> DataFrame:
    """Each query's hits in rank order without exact and near duplicates of hits already kept, `most` at most.

    A group has the candidates of one query, a fixed number. Adds kept_rank."""
    rows = hits.withColumn("norm", normalize_text(F.coalesce(F.col(text), F.lit(""))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields) + ", kept_rank int"
    return rows.groupBy(query).applyInPandas(lambda pdf: _keep(pdf, most), schema)


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
