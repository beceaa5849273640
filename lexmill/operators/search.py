"""Exact nearest neighbours, the evidence gate and retrieval scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates fetched for K wanted: max(3K, K + 5).
WANTED = 5
CANDIDATES = max(3 * WANTED, WANTED + 5)
#: Rows of a tile on either side of a search.
TILE = 8192


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _tile(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    q_ids, r_ids = queries.column("id").to_numpy(), rows.column("id").to_numpy()
    kept: list[tuple] = []
    if len(q_ids) and len(r_ids):
        q, r = _matrix(queries.column("v")), _matrix(rows.column("v"))
        q, r = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, r))
        for at in range(0, len(q), 512):
            distance = np.round(1 - q[at : at + 512] @ r.T, 9)
            # All rows up to the k-th distance, ties included; only these are sorted.
            last = np.partition(distance, k - 1, axis=1)[:, k - 1] if distance.shape[1] > k else np.full(len(distance), np.inf)
            i, j = np.nonzero(distance <= last[:, None])
            near = distance[i, j]
            order = np.lexsort((r_ids[j], near, i))
            i, j, near = i[order], j[order], near[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            kept.append((q_ids[at + i[best]], r_ids[j[best]], near[best]))
    found = [np.concatenate(c) for c in zip(*kept, strict=True)] if kept else [np.zeros(0)] * 3
    return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "distance": pa.array(found[2], pa.float64())})


def knn(rows: DataFrame, queries: Column, k: int = CANDIDATES, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest by cosine distance, ties to the smaller id, for rows where `queries` holds.

    Query tiles meet row tiles; each pair of tiles keeps k of each query, and the merge ranks these. The search is exact, so its products are
    queries x rows, and each row is sent once for every query tile. Vectors that are null or zero, hold null, infinite or NaN
    components or have another size than most take no part.
    """
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = rows.filter(F.coalesce(F.exists(vector, lambda x: x != 0) & finite, F.lit(False)))
    size = sound.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    good = sound.filter(F.size(vector) == (size["d"] if size else 0)).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("asks"))
    sizes = good.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    r_tiles, q_tiles = (max(1, -(-n // TILE)) for n in sizes)
    deal = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")  # noqa: E731 - by rows, so that a repeated id is in many tiles
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A row's own tile comes first: beside the explode it would be dealt anew for each copy.
    asked = good.filter("asks").select("id", "v", deal(q_tiles).alias("q_tile")).select("*", all_of(r_tiles).alias("r_tile"))
    held = good.select("id", "v", deal(r_tiles).alias("r_tile")).select("*", all_of(q_tiles).alias("q_tile"))
    met = asked.groupBy("q_tile", "r_tile").cogroup(held.groupBy("q_tile", "r_tile")).applyInArrow(lambda q, r: _tile(q, r, k), "query_id long, vec_id long, distance double")
    by = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return met.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def gate(queries: DataFrame, hits: DataFrame, metric: str | None, max_distance: float | None) -> DataFrame:
    """(query_id, sufficient, best_distance, reason): only no hits, or all of them too far, block a question."""
    from ..functions.text import cosine_distance

    distance = cosine_distance(F.col("distance"), F.lit(metric))
    best = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(distance).alias("best_distance"))
    far = F.lit(max_distance).cast("double")
    reason = (
        F.when(F.col("n").isNull(), "no_results")
        .when(far.isNull(), "threshold_disabled")
        .when(~F.coalesce(F.lit(metric).isin("cosine", "l2", "ip"), F.lit(False)), "unknown_metric")
        .when(F.col("best_distance").isNull(), "no_distance_info")
        .when(F.col("best_distance") <= far, "ok")
        .otherwise("too_far")
    )
    judged = queries.select("query_id").join(best, "query_id", "left").withColumn("reason", reason)
    return judged.select("query_id", (~F.col("reason").isin("no_results", "too_far")).alias("sufficient"), "best_distance", "reason")


def hit_at(ranks: DataFrame, rank: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """The share of cases whose first match has rank k or better; no match is a miss."""
    return ranks.agg(*[F.avg(F.coalesce((F.col(rank) <= k).cast("int"), F.lit(0))).alias(f"hit{k}") for k in ks])
