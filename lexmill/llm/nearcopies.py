"""Near-copy removal for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sides. The SimHash operator's ball hashing, over fingerprints of the five-word shingles, links the texts that
hardly differ; two bits are too few for 0.8 (about ten of 64 differ there), so the prefix filter of `operators.selfjoin` adds all the rest: sets of 0.8 share a shingle
among their rarest ones, whichever order of rarity is taken, at places that leave enough of both. Of these, pairs are dropped whose shingles, counted in BINS by
their hash, can't overlap enough; all others are verified by the similarity of their sets. No pair of 0.8 is lost but by equal 64-bit hashes of different shingles.

Where texts meet at a shingle each first meets the smallest one and the NEAR before it, so that thousands of copies of one text become one component after a number of
comparisons linear in them. Then every text outside the largest component of those that meet there meets all of other components that fit: no
pair that could join components is left out. Frequent shingles come last in every text's order, and their groups are split.

Texts of the same words are one node, however many. Texts of fewer than five words are one shingle; those without words (null, empty, blanks)
are copies of each other. Very long texts are sorted by their hashes, eight bytes a word. Empty tables give empty results; a table's columns may have any names. Repeated rows are
copies, and of ties in the id the first row stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.selfjoin import SIMILARITY, Order, fits, in_sample, order_of, probe_length
from .common import LOWER_BYTES, as_bytes, boxed, slices, unboxed, written
from .simhash import SEED, components, fingerprint_of, links

SHINGLE, NEAR, BINS = 5, 7, 256
#: Parts of the group of a frequent shingle.
SALTS = 64
#: Removed rows are broadcast by their numbers up to so many (16 MB), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted: hashes of words, joined by a polynomial and mixed."""
    words = text.translate(LOWER_BYTES).split()
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(h))
    out = np.full(max(len(h) - n + 1, 0) if n else 0, n, dtype=np.uint64)
    for i in range(n):
        out = out * _FACTOR + h[i : i + len(out)]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique((out ^ (out >> np.uint64(29))).view(np.int64))


def counted(found: np.ndarray) -> bytes:
    """How many tokens lie in each bin; a bin too full to tell counts as holding any number."""
    return np.minimum(np.bincount(found & (BINS - 1), minlength=BINS), 65535).astype("<u2").tobytes()


def needed(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | float:
    """The overlap that sets of n and m need."""
    return SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-9


def signed(df: DataFrame) -> DataFrame:
    """Adds `key` and `id`, the same for texts of the same words (`id` has 64 bits of the key), `fp` (the fingerprint), `size` and `bins`."""
    own = [T.StructField("key", T.StringType()), T.StructField("id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bins", T.BinaryType())]
    schema = T.StructType([*df.schema.fields, *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices([b]):
                keys, ids, prints, sizes, bins = [], [], [], [], []
                for x in as_bytes(s.column("text")):
                    found, key = tokens(x), xxhash.xxh128_digest(b" ".join(x.translate(LOWER_BYTES).split()))
                    keys.append(key.hex())
                    ids.append(int.from_bytes(key[:8], "big", signed=True))
                    prints.append(fingerprint_of(found))
                    sizes.append(len(found))
                    bins.append(counted(found))
                made = [pa.array(c, t) for c, t in zip((keys, ids, prints, sizes, bins), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*s.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)


def sampled(texts: DataFrame) -> DataFrame:
    """(token) of texts (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([tokens(x) for x in as_bytes(b.column("text"))]) if b.num_rows else np.zeros(0, dtype=np.int64))], names=["token"])

    return texts.select("text").mapInArrow(run, "token long")


def first_tokens(texts: DataFrame, order: Order) -> DataFrame:
    """(token, id, size, pos, frequent) of the rarest tokens of texts (id, text), once for each id and task."""
    held = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = held.value, set()
        for b in slices(batches):
            parts = []
            for own, x in zip(b.column("id").to_pylist(), as_bytes(b.column("text")), strict=True):
                if own not in seen:
                    seen.add(own)
                    found = tokens(x)
                    first, frequent = order.arranged(found, probe_length(len(found), SIMILARITY))
                    n = len(first)
                    parts.append((first, np.full(n, own, dtype=np.int64), np.full(n, len(found), dtype=np.int32), np.arange(n, dtype=np.int32), frequent))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["token", "id", "size", "pos", "frequent"])

    return texts.select("id", "text").mapInArrow(run, "token long, id long, size int, pos int, frequent boolean")


def meeting(first: DataFrame, nodes: DataFrame) -> DataFrame:
    """(token, salt, at) of nodes at tokens that others have too; at is (size, node, pos)."""
    salted = first.withColumn("salt", F.when(F.col("frequent"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    by = Window.partitionBy("token", "salt")
    shared = salted.withColumn("least", F.min("id").over(by)).withColumn("most", F.max("id").over(by)).filter("frequent or least <> most")
    return shared.join(nodes.select("id", "node"), "id").select("token", "salt", "frequent", F.struct("size", "node", "pos").alias("at")).distinct()


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes whose fingerprints are equal or linked by ball hashing."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(least, "fp").filter("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    ball = links(least).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.union(ball.select(*ordered(F.col("x"), F.col("y"))))


def fitting(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of places (x, y) of a common token that fit."""
    x, y = F.col("x"), F.col("y")
    fit = pairs.filter((x["node"] != y["node"]) & fits(F.least(x, y), F.greatest(x, y)))
    return fit.select(*ordered(x["node"], y["node"])).distinct()


def in_line(met: DataFrame) -> DataFrame:
    """Pairs of nodes that meet at a token: each with the first there and the NEAR before it, in parts of a frequent token also with the first of all.

    First is where the token comes first: a text with few shingles of its own is the likeliest to be similar to others."""
    by = Window.partitionBy("token", "salt")
    order = F.struct(F.col("at")["pos"], F.col("at")["size"], F.col("at")["node"])
    partners = F.array(F.min_by("at", order).over(by), *[F.lag("at", i).over(by.orderBy(order)) for i in range(1, NEAR + 1)])
    near = met.withColumn("partners", F.array_compact(F.array_distinct(partners))).select(F.explode("partners").alias("x"), F.col("at").alias("y"))
    often = met.filter("frequent")
    first = often.groupBy("token").agg(F.min_by("at", order).alias("x"))
    return fitting(near.union(often.join(first, "token").select("x", F.col("at").alias("y"))))


def across(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that meet at a token and may not have met in line: those outside its largest component, with all others."""
    placed = met.withColumn("node", F.col("at")["node"]).join(roots, "node", "left").select("token", "frequent", "at", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"), F.max("frequent").alias("frequent"))
    mixed = parts.groupBy("token").agg(F.max("frequent").alias("frequent"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"), F.max_by("root", F.struct("n", "root")).alias("largest")).filter((F.col("parts") > 1) & (F.col("frequent") | (F.col("all") > NEAR + 1)))
    open_ = placed.join(mixed.select("token", "largest"), "token")
    minor = open_.filter("root <> largest").select("token", F.col("at").alias("x"), F.col("root").alias("own"))
    x, y = F.col("x"), F.col("at")
    fit = (F.col("own") != F.col("root")) & ((F.col("root") == F.col("largest")) | (x["node"] < y["node"])) & fits(F.least(x, y), F.greatest(x, y))
    return fitting(minor.join(open_, "token").filter(fit).select("x", y.alias("y")))


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose bins can hold the overlap that they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8192):
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u2").reshape(b.num_rows, -1) for c in ("x", "y"))
            full = ((x == 65535) | (y == 65535)).any(axis=1) if b.num_rows else np.zeros(0, dtype=bool)
            n, m = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            yield b.select(["a", "b"]).filter(pa.array((most >= needed(n, m)) | full | (n + m == 0)))

    of = lambda key, name, size: nodes.select(F.col("node").alias(key), F.col("bins").alias(name), F.col("size").alias(size))
    return pairs.join(of("b", "y", "m"), "b").join(of("a", "x", "n"), "a").select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of SIMILARITY or more; texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, dtype=np.int64)
        for b in slices(batches):
            keep = []
            for a, x, y in zip(b.column("a").to_pylist(), as_bytes(b.column("x")), as_bytes(b.column("y")), strict=True):
                if a != last:
                    last, own = a, tokens(x)
                other = tokens(y)
                keep.append(len(np.intersect1d(own, other, assume_unique=True)) >= needed(len(own), len(other)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id (null ids last), and of equal ids the first row.

    Texts are written once and read where they are, by the sample, the prefix filter, the verification of candidates and the result; what is grouped and joined are numbers and signatures."""
    rows = written(signed(boxed(docs, "doc_id", "text")).drop("text").withColumn("_row", F.monotonically_increasing_id()), "signed")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_row").alias("r"))
    of = rows.select("key", "_row", rank.alias("rank"), "id", "fp", "size", "bins")
    nodes = written(of.groupBy("key").agg(F.min("rank").alias("rank"), *[F.first(c).alias(c) for c in ("id", "fp", "size", "bins")]).withColumn("node", F.col("rank")["r"]), "nodes")
    texts = rows.select(F.col("_row").alias("node"), "id", F.col("_doc")["text"].alias("text"))
    order = order_of(sampled(texts.filter(in_sample(F.col("id")))))
    met = written(meeting(first_tokens(texts, order), nodes), "meeting")
    links_ = lambda pairs: written(verified(written(alike(pairs, nodes), "candidates"), texts), "links")
    first = links_(in_line(met).union(by_fingerprint(nodes)).distinct())
    roots = components(first)
    second = links_(across(met, roots))
    if not second.isEmpty():
        roots = components(first.union(second))
    # Of each component the node of smallest rank stays; nodes without links stay all.
    member = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    ranked = written(nodes.select("node", "rank").join(member, "node"), "members")
    least = ranked.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank")["r"].alias("node"))
    kept = nodes.select("node").join(ranked.select("node"), "node", "left_anti").union(least).withColumnRenamed("node", "_row")
    removed = written(of.select("_row").join(kept, "_row", "left_anti"), "removed")
    small = removed.count() <= BROADCAST_ROWS
    return unboxed(rows.join(F.broadcast(removed) if small else removed, "_row", "left_anti"), docs)
