"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected at random, once for each curve, and ordered by the Hilbert index of their shifted projections.
Spark partitions all curves' keys by range and sorts each range; a query is compared with the window of rows about its
own key on every curve, and the windows' best merge. Comparison inside windows is by vectors of one byte a
component with a scale of their own; the KEEP * k best of each query are reranked by the exact measure in double precision. For inner products vectors get one more
component that makes their norms equal, so that near on the sphere means a large product.

A window holds WINDOW_SHARE * rows ** WINDOW_POWER rows unless `window` says how many: data without structure need windows
that grow so, data with clusters are served by a fixed number (the README has candidate shares and recall). A window ends where a range partition
does; each partition has many windows.

Rows with a null or zero vector, with null or non-finite components, or of another dimension than most, take no part.
Of equal vectors only the first k + 1 by id can be among a query's nearest, so no more of each are searched, and equal query
vectors are searched once; all rows are indexed by that. Repeated ids are rows of their own. An empty table gives no rows; other columns
don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import embeddings, written

#: Curves, projected dimensions and bits of each.
CURVES, DIMENSIONS, BITS = 48, 10, 4
WINDOW_SHARE, WINDOW_POWER, LEAST_WINDOW = 0.08, 5 / 6, 64
#: Windows of a range partition at least.
WINDOWS = 8
#: How many times k rows of each query are reranked exactly.
KEEP = 2
#: Vectors whose keys are computed at a time.
KEYED = 8192
SEED = 7


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of points (rows) with integer coordinates under 2^bits (Skilling's transform)."""
    x = cells.T.astype(np.int64)
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> b) & 1, flip ^ ((1 << b) - 1), flip)
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def curve_keys(points: np.ndarray, spread: float) -> Iterator[np.ndarray]:
    """The points' Hilbert keys, curve by curve. Projections go through a logistic function, so that cells hold alike numbers of rows."""
    d = points.shape[1]
    for c in range(CURVES):
        rng = np.random.default_rng([SEED, c])
        axes = np.linalg.qr(rng.normal(size=(d, d)))[0][:, : min(DIMENSIONS, d)]
        even = 1 / (1 + np.exp(np.clip(points @ axes * (-1.7 / spread), -50, 50)))
        yield hilbert(((even + rng.uniform(0, 1, axes.shape[1])) / 2 * (1 << BITS)).astype(np.int64), BITS)


#: id, curve, key, a mark that spreads equal keys, the vector in bytes and its scale.
PLACED = "id long, asks boolean, curve int, key long, mark int, v binary, scale double"


def placed(rows: DataFrame, norm: float, spread: float) -> DataFrame:
    """rows (id, v, asks) on every curve. Queries lie on the sphere of radius `norm` with nothing in the extra component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, KEYED):
                b = whole.slice(at, KEYED)
                v, asks = vectors_of(b.column("v")), b.column("asks").to_numpy(zero_copy_only=False)[:, None]
                length = np.linalg.norm(v, axis=1, keepdims=True)
                points = np.hstack([np.where(asks, v * (norm / length), v), np.where(asks, 0, np.sqrt(np.maximum(0, norm**2 - length**2)))])
                scale = np.abs(v).max(axis=1, keepdims=True) / 127
                coded = np.rint(v / scale).astype(np.int8)
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(v.shape[1]), len(v), [None, pa.py_buffer(np.ascontiguousarray(coded))]).cast(pa.binary())
                ids = b.column("id")
                mark = (ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int32)
                for c, key in enumerate(curve_keys(points, spread)):
                    yield pa.RecordBatch.from_arrays(
                        [ids, b.column("asks"), pa.array(np.full(len(v), c), pa.int32()), pa.array(key), pa.array(mark, pa.int32()), binary, pa.array(scale[:, 0])],
                        names=["id", "asks", "curve", "key", "mark", "v", "scale"],
                    )

    return rows.select("id", "v", "asks").mapInArrow(run, PLACED)


def best_in_windows(sorted_rows: DataFrame, window: int, keep: int) -> DataFrame:
    """(query, id, about): for each query on each curve the `keep` best rows of its window, by the rows' order in their partition.

    A partition streams through; what is held is one step of rows and half a window before and after it.
    """
    half, step = max(1, window // 4), max(2, window // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        begin = 0  # rows of `held` before it only serve as neighbours
        for b in batches:
            fresh = pa.Table.from_batches([b])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            if held.num_rows - begin < 4 * step + half:
                continue
            stop = begin + (held.num_rows - half - begin) // step * step
            yield from compared(held, begin, stop)
            held, begin = held.slice(max(0, stop - half)), min(half, stop)
        if held is not None and held.num_rows:
            yield from compared(held, begin, held.num_rows)

    def compared(table: pa.Table, begin: int, stop: int) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        ids, curve = table.column("id").to_numpy(), table.column("curve").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        scale = table.column("scale").to_numpy()
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=np.int8).reshape(len(ids), -1).astype(np.float32)
        found: list[list] = [[], [], []]
        for at in range(begin, stop, step):
            end = min(at + step, stop)
            q = at + np.flatnonzero(asks[at:end])
            if not len(q):
                continue
            low = max(0, at - half)
            near = low + np.flatnonzero(~asks[low : end + half])
            if not len(near):
                continue
            about = (v[q] @ v[near].T) * scale[near] * scale[q][:, None]
            about[curve[q][:, None] != curve[near]] = -np.inf
            n = min(keep, len(near))
            top = np.argpartition(about, len(near) - n, axis=1)[:, len(near) - n :]
            value = np.take_along_axis(about, top, axis=1)
            i, j = np.nonzero(value > -np.inf)
            for column, x in zip(found, (ids[q[i]], ids[near[top[i, j]]], value[i, j]), strict=True):
                column.append(x)
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "id", "about"])

    return sorted_rows.mapInArrow(run, "query long, id long, about double")


def nearest(rows: DataFrame, queries: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", window: int | None = None) -> DataFrame:
    """(query, neighbours): the array of up to k (score, id), nearest first, for each row where `queries` holds."""
    spark = rows.sparkSession
    good = rows.filter(usable(F.col(vector)) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("is_query"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top"), F.avg(square).alias("mean")).orderBy(F.desc("n"), "d").first()
    if facts is None:
        return spark.createDataFrame([], "query long, neighbours array<struct<score:double,id:long>>")
    good = good.filter(F.size("v") == facts["d"])
    norm, spread = float(np.sqrt(facts["top"])), float(np.sqrt(facts["mean"] / facts["d"]))
    # Rows are told apart by a number, not by their id, from one written table on.
    good = written(good.withColumn("row", F.monotonically_increasing_id()), "rows")
    copies = F.row_number().over(Window.partitionBy("v").orderBy("id", "row"))
    index = written(good.select("row", "id", "v").withColumn("copy", copies).filter(F.col("copy") <= k + 1).drop("copy"), "indexed")
    asked = written(good.filter("is_query").groupBy("v").agg(F.min("row").alias("row")).select("row", "v"), "asked")
    both = index.select(F.col("row").alias("id"), "v", F.lit(False).alias("asks")).union(asked.select(F.col("row").alias("id"), "v", F.lit(True).alias("asks")))
    wide = window or max(LEAST_WINDOW, int(WINDOW_SHARE * facts["n"] ** WINDOW_POWER))
    # Windows end where partitions do, so a partition has several.
    partitions = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), CURVES * facts["n"] // (WINDOWS * wide)))
    by = ["curve", "key", "mark"]
    ordered = placed(both, norm, spread).repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    met = best_in_windows(ordered, wide, KEEP * k + 1)
    # The same pair may come from several curves; a query's own row and its copies take places of their own.
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("about"), "id"))
    about = met.groupBy("query", "id").agg(F.max("about").alias("about")).withColumn("rank", ranked).filter(F.col("rank") <= KEEP * k + 1)
    rows_of = index.select(F.col("row").alias("id"), F.col("id").alias("vec_id"), F.col("v").alias("x"))
    pairs = about.select("query", "id").join(rows_of, "id").join(asked.select(F.col("row").alias("query"), F.col("v").alias("y")), "query")
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    near = F.struct((-score).alias("s"), F.col("vec_id").alias("id"), F.col("id").alias("row"))
    lists = pairs.select("query", near.alias("near")).groupBy("query").agg(F.sort_array(F.collect_list("near")).alias("near"))
    answers = asked.select(F.col("row").alias("query"), "v").join(lists, "query").select("v", "near")
    own = good.filter("is_query").select(F.col("id").alias("query"), "row", "v").join(answers, "v")
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("row")), 1, k)
    return own.select("query", F.transform(others, lambda x: F.struct((-x["s"]).alias("score"), x["id"].alias("id"))).alias("neighbours"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)
    ranked = found.select(F.col("query").alias("query_id"), F.posexplode("neighbours").alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x")["id"].alias("vec_id"), F.col("x")["score"].alias("score"))
