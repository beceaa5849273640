"""A stored vector index: inverted lists of a coarse quantiser, residuals as product codes, exact distances at the end.

Only the quantisers are fitted on a sample, bounded by SAMPLE_ROWS and SAMPLE_BYTES; every row is in the index. Its list is found where the row is. A list has
parts of about TILE rows, so that a list with many rows, such as copies of one vector, is many groups. A row keeps its code and how far the code is from it. How many lists a search looks into, and how many
candidates it measures exactly, are set when the index is built, so that SOUGHT of the true neighbours are found on the sample.

Parts of lists that lie near each other make tiles of about TILE rows. A search sends queries, TILE of them at a time, to the tiles of their nearest lists, which choose the best
by code, measure these by the stored vectors and hand on as many as are wanted, so that no pair of a query and a row leaves its tile otherwise. `exact` then goes on: in tiles whose lists
may hold anything nearer than what was found, by the triangle inequality, all rows are measured, so that the result is that of comparing all. Distances are cosine distances.

Vectors that are null or zero, hold null, infinite or NaN components or have another size than most aren't indexed. Repeated ids are rows of their own. An empty index finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import written

SAMPLE_ROWS, SAMPLE_BYTES, TILE = 16_384, 32_000_000, 8192
#: Rows of the sample for a list at least, and lists at most.
ROWS_A_LIST, MOST_LISTS = 16, 4096
SUBSPACES, WORDS, ROUNDS, SEED = 16, 256, 8, 7
#: Share of the true neighbours that probes and candidates are set for, how many neighbours, and how many of the sample ask.
SOUGHT, NEIGHBOURS, ASKING = 0.97, 20, 256
#: Rows of an Arrow batch that meet all centres at a time.
CODED = 1024
#: What rounding may change in a length, and in a cosine distance.
SLACK, ROUNDED = 1e-6, 2e-9
INFO = "rows long, size int, lists int, parts int, probes int, candidates int"


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres by Lloyd's rounds; an empty cluster takes the row farthest from its centre."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        d = squares(x, centres)
        own = d.argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        far = np.argsort(-d[np.arange(len(x)), own])
        for i, c in enumerate(np.flatnonzero(counts == 0)):
            centres[c] = x[far[i % len(x)]]
    return centres


@dataclass
class Quantiser:
    """Centres of lists, and code words of the subspaces of residuals; of a size fixed by the parameters."""

    centres: np.ndarray
    words: list[np.ndarray]

    @staticmethod
    def fitted(sample: np.ndarray, lists: int) -> Quantiser:
        rng = np.random.default_rng(SEED)
        centres = clusters(sample, lists, rng)
        rest = sample - centres[squares(sample, centres).argmin(1)]
        parts = np.array_split(rest, min(SUBSPACES, sample.shape[1]), axis=1)
        return Quantiser(centres, [clusters(p, min(WORDS, len(p)), rng) for p in parts])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, distance of the decoded vector) of each row."""
        own = squares(x, self.centres).argmin(1)
        parts = np.array_split(x - self.centres[own], len(self.words), axis=1)
        codes = np.stack([squares(p, w).argmin(1) for p, w in zip(parts, self.words, strict=True)], axis=1).astype(np.uint8)
        return own, codes, np.linalg.norm(x - self.decoded(own, codes), axis=1)

    def decoded(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[own] + np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)


def tuned(q: Quantiser, sample: np.ndarray) -> tuple[int, int]:
    """(probes, candidates) with which SOUGHT of the neighbours within the sample are found."""
    asking = sample[:: max(1, len(sample) // ASKING)]
    k = min(NEIGHBOURS, len(sample))
    true = np.argsort(squares(asking, sample), axis=1)[:, :k]
    own, codes, _ = q.coded(sample)
    places = np.argsort(np.argsort(squares(asking, q.centres), axis=1), axis=1)
    probes = int(np.quantile(places[np.arange(len(asking))[:, None], own[true]], SOUGHT)) + 1
    ranks = np.argsort(np.argsort(squares(asking, q.decoded(own, codes)), axis=1), axis=1)
    candidates = int(np.quantile(np.take_along_axis(ranks, true, axis=1), SOUGHT)) + 1
    return probes, max(4 * NEIGHBOURS, candidates)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _slices(batches):
    for b in batches:
        yield from (b.slice(at, CODED) for at in range(0, b.num_rows, CODED))


def sound(rows: DataFrame, vector: str) -> DataFrame:
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.coalesce(F.exists(vector, lambda x: x != 0) & finite, F.lit(False)))


def build(rows: DataFrame, path: str, id: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """An index of rows at `path`, which must not exist. The info is written last, and without it there is no index."""
    spark = rows.sparkSession
    named = sound(rows.select(F.col(id).alias("id"), F.col(vector).alias("v")), "v")
    size = named.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = size["d"] if size else 0
    # Numbers of rows come from one reading of the input and are written, so they hold.
    held = written(named.filter(F.size("v") == width).select("id", F.col("v").cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")
    n = held.count()
    wanted = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // max(8 * width, 1)))
    picked = held.orderBy(F.xxhash64("row"), "row").limit(wanted).select("v").toArrow()
    sample = unit(matrix(picked.column("v"))) if n else np.zeros((1, 1))
    lists = int(max(1, min(MOST_LISTS, len(sample) // ROWS_A_LIST, round(n**0.5))))
    q = Quantiser.fitted(sample, lists)
    probes, candidates = tuned(q, sample) if n else (1, 1)
    model = spark.sparkContext.broadcast(q)

    def run(batches):
        q = model.value
        for b in _slices(batches):
            if b.num_rows:
                own, codes, off = q.coded(unit(matrix(b.column("v"))))
                made = [pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), b.column("v"), *made], names=["id", "row", "v", "list", "code", "off"])

    fields = f"id {named.schema['id'].dataType.simpleString()}, row long, v array<double>, list int, code binary, off double"
    coded = written(held.mapInArrow(run, fields), "coded")
    counts = coded.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("most_off"))
    parts = counts.select("list", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    dealt = coded.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")  # a row for each of MOST_LISTS lists
    dealt.write.parquet(f"{path}/rows")
    rows_of = [(i, [float(x) for x in c]) for i, c in enumerate(q.centres)]
    spark.createDataFrame(rows_of, "list int, centre array<double>").write.parquet(f"{path}/centres")
    spark.createDataFrame([(i, j, [float(x) for x in w]) for i, part in enumerate(q.words) for j, w in enumerate(part)], "subspace int, word int, value array<double>").write.parquet(f"{path}/words")
    # How far a list's rows lie from its centre at most: what a list may hold is bounded by it.
    radii = dealt.select("list", "part", "v").mapInArrow(_radii(model), "list int, part int, radius double").groupBy("list", "part").agg(F.max("radius").alias("radius"))
    radii.write.parquet(f"{path}/parts")
    spark.createDataFrame([(n, width, lists, int(parts.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]), probes, candidates)], INFO).coalesce(1).write.parquet(f"{path}/_info")
    return VectorIndex(spark, path)


def _radii(model):
    def run(batches):
        for b in _slices(batches):
            if b.num_rows:
                own = b.column("list").to_numpy(zero_copy_only=False)
                far = np.linalg.norm(unit(matrix(b.column("v"))) - model.value.centres[own], axis=1)
                yield pa.RecordBatch.from_arrays([b.column("list"), b.column("part"), pa.array(far)], names=["list", "part", "radius"])

    return run


class VectorIndex:
    """A built index, opened by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.info = spark.read.schema(INFO).parquet(f"{path}/_info").first()
        self.rows = spark.read.parquet(f"{path}/rows")
        centres = spark.read.parquet(f"{path}/centres").orderBy("list").toArrow()  # MOST_LISTS at most
        words = spark.read.parquet(f"{path}/words").orderBy("subspace", "word").collect()  # SUBSPACES x WORDS at most
        listed: dict[int, list] = {}
        for w in words:
            listed.setdefault(w["subspace"], []).append(w["value"])
        self.model = spark.sparkContext.broadcast(Quantiser(matrix(centres.column("centre")), [np.array(v) for v in listed.values()]))

    def search(self, queries: DataFrame, k: int, id: str = "query_id", vector: str = "embedding", without: Column | None = None, probes: int | None = None, candidates: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, id, distance, rank): the k nearest rows of each query; ties to the smaller id. `without` says of (query_id, id) what is no candidate.

        Query ids must differ. Queries that can't be compared find nothing."""
        asked = sound(queries.select(F.col(id).alias("query_id"), F.col(vector).cast("array<double>").alias("q")), "q").filter(F.size("q") == self.info["size"])
        asked = written(asked.withColumn("asked", F.monotonically_increasing_id()), "asked")
        blocks = max(1, -(-asked.count() // TILE))
        wanted = max(candidates or self.info["candidates"], k)
        none = F.lit(None).cast("double")
        near = written(self._met(asked.withColumn("limit", none), blocks, probes or self.info["probes"], wanted, k if without is None else wanted, without), "near")
        if exact:
            kth = near.groupBy("query_id").agg(F.sort_array(F.collect_list("distance")).alias("d")).select("query_id", F.when(F.size("d") >= k, F.get("d", F.lit(k - 1))).alias("limit"))
            limits = written(asked.join(kth, "query_id", "left").select("query_id", "q", "asked", F.coalesce("limit", F.lit(2.0)).alias("limit")), "limits")
            near = self._met(limits, blocks, 0, 0, k if without is None else None, without)
        return _ranked(near, k)

    def _tiles(self) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        """(list, part, tile) for the rows, and the list, radius and tile of each part: a row for each list and TILE rows."""
        parts = self.spark.read.parquet(f"{self.path}/parts").join(self.rows.groupBy("list", "part").agg(F.count(F.lit(1)).alias("n")), ["list", "part"]).orderBy("list", "part").toPandas()
        centres = self.model.value.centres
        # Lists in the order of their centres along the direction in which these differ most.
        along = centres @ np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
        lists = parts["list"].to_numpy(dtype=np.int64)
        order = np.lexsort((parts["part"].to_numpy(), lists, along[lists])) if len(parts) else np.zeros(0, dtype=np.int64)
        tile = np.zeros(len(parts), dtype=np.int64)
        tile[order] = (np.cumsum(parts["n"].to_numpy()[order]) - 1) // TILE
        known = self.spark.createDataFrame(list(zip(lists.tolist(), parts["part"].tolist(), tile.tolist(), strict=True)), "list int, part int, tile int")
        return known, lists, parts["radius"].to_numpy(dtype=float), tile

    def _met(self, asked: DataFrame, blocks: int, probes: int, wanted: int, keep: int | None, without: Column | None) -> DataFrame:
        """(query_id, id, row, distance) of asked (query_id, q, asked, limit): in each tile the `keep` nearest (None: all) of those whose code is among the best `wanted` in the query's nearest lists;
        or, where there is a limit, of all rows of lists that may hold anything within it, and only those within it."""
        model, (known, lists, radius, tile) = self.model, self._tiles()
        order = np.argsort(tile, kind="stable")
        starts = np.flatnonzero(np.diff(tile[order], prepend=-1))
        names = tile[order][starts]
        held = self.spark.sparkContext.broadcast((lists[order], radius[order], starts, names))

        def send(batches):
            lists, radius, starts, names = held.value
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    d = np.sqrt(squares(unit(matrix(part.column("q"))), model.value.centres))
                    limit = part.column("limit").to_numpy(zero_copy_only=False).astype(float)
                    # Lists up to the last one of the probes, or those within reach.
                    cut = np.full(len(d), np.inf) if not probes or probes >= d.shape[1] else np.partition(d, probes - 1, axis=1)[:, probes - 1] + SLACK
                    least = d[:, lists]
                    open_ = least <= (cut[:, None] if probes else radius + SLACK + np.sqrt(2 * (limit + ROUNDED))[:, None])
                    i, j = np.nonzero(np.logical_or.reduceat(open_, starts, axis=1)) if len(starts) else (np.zeros(0, dtype=np.int64),) * 2
                    kept = part.take(pa.array(i))
                    block = pa.array((kept.column("asked").to_numpy() % blocks).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([kept.column("query_id"), kept.column("q"), kept.column("limit"), pa.array(cut[i]), pa.array(names[j], pa.int32()), block], names=["query_id", "q", "limit", "cut", "tile", "block"])

        kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema.fields, *self.rows.schema.fields]}
        sent = asked.select("query_id", "q", "asked", "limit").mapInArrow(send, f"query_id {kinds['query_id']}, q array<double>, limit double, cut double, tile int, block int")
        rows = self.rows.join(F.broadcast(known), ["list", "part"]).select("id", "row", "v", "list", "code", "tile", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

        def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
            found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
            if queries.num_rows and rows.num_rows:
                rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])  # places settle ties
                q, v, own = unit(matrix(queries.column("q"))), unit(matrix(rows.column("v"))), rows.column("list").to_numpy()
                cut, limit = queries.column("cut").to_numpy(), queries.column("limit").to_numpy(zero_copy_only=False).astype(float)
                x = _decoded(model.value, rows) if probes else None
                used, at_ = np.unique(own, return_inverse=True)
                for at in range(0, len(q), 512):
                    some = q[at : at + 512]
                    if probes:
                        d = squares(some, x)
                        d[(np.sqrt(squares(some, model.value.centres[used])) > cut[at : at + 512, None])[:, at_]] = np.inf
                        best = np.argpartition(d, wanted - 1, axis=1)[:, :wanted] if d.shape[1] > wanted else np.tile(np.arange(d.shape[1]), (len(d), 1))
                        i, j = np.repeat(np.arange(len(d)), best.shape[1]), best.ravel()
                        good = np.isfinite(d[i, j])
                    else:
                        i, j = np.nonzero(1 - some @ v.T <= limit[at : at + 512, None] + ROUNDED)
                        good = np.ones(len(i), dtype=bool)
                    i, j = i[good], j[good]
                    mine = []
                    for a, z in [(a, a + 100_000) for a in range(0, len(i), 100_000)]:  # vectors of so many pairs at a time
                        mine.append((i[a:z] + at, j[a:z], np.round(1 - (some[i[a:z]] * v[j[a:z]]).sum(axis=1), 9) + 0.0))
                    found += _nearest(mine, keep) if mine and keep is not None else mine
            i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.table({"query_id": queries.column("query_id").take(pa.array(i)), "id": rows.column("id").take(pa.array(j)), "row": rows.column("row").take(pa.array(j)), "distance": pa.array(d, pa.float64())})

        met = sent.groupBy("tile", "block").cogroup(rows.groupBy("tile", "block")).applyInArrow(lambda a, b: run(a, b), f"query_id {kinds['query_id']}, id {kinds['id']}, row long, distance double")
        met = met if without is None else met.filter(~F.coalesce(without, F.lit(False)))
        return met if keep is None else _ranked(met, keep, True)


def _nearest(found: list[tuple], keep: int) -> list[tuple]:
    """The `keep` nearest of each query among (query, row, distance), ties to the smaller row."""
    i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    near = np.arange(len(i)) - np.searchsorted(i, i) < keep
    return [(i[near], j[near], d[near])]


def _ranked(near: DataFrame, k: int, row: bool = False) -> DataFrame:
    """The k nearest of each query; ties to the smaller id."""
    by = Window.partitionBy("query_id").orderBy("distance", "id", "row")
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "id", *(["row"] if row else []), "distance", *([] if row else ["rank"]))


def _decoded(q: Quantiser, rows: pa.Table) -> np.ndarray:
    codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)
    return q.decoded(rows.column("list").to_numpy(), codes)
