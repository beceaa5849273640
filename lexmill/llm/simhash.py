"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at distance 2 or less share a point at distance 1 or less from both, so every fingerprint emits its
65 variants within half the radius. Fingerprints that meet at a variant are within the radius of each other by the
triangle inequality; each is linked to the smallest that meets there, and the distance of every link is verified. A
link between any two is thereby kept as a path. Everything runs on distinct fingerprints, so that copies of a text,
however many, are one row.

Null texts count as empty; texts without words have fingerprint zero. Rows with a null id take part; a component's id
is its smallest id that isn't null. Repeated rows are in one component. Very long texts are summed up in blocks. Empty tables give empty results;
other columns than doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, as_bytes, boxed, documents, slices, unboxed, written

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Fingerprints that are joined by broadcast, 16 bytes each; any other has less than one row of so many.
FREQUENT = 10_000


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one UTF-8 text, as a signed integer."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return fingerprint_of([hashed(b" ".join(words), SEED)])
    return fingerprint_of([hashed(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:], strict=False)])


def fingerprint_of(hashes: list[int]) -> int:
    """The fingerprint of a text by its shingles' hashes."""
    if not len(hashes):
        return 0
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(raw), 1 << 15):  # long texts in blocks, so that memory stays bounded
        ones += np.unpackbits(raw[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Adds the fingerprint column; all other columns pass through."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.LongType(), False)])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = pa.array([fingerprint(x) for x in as_bytes(b.column(text))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fp], names=[*keep, name])

    return df.mapInArrow(run, schema)


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints, enough to connect all at RADIUS or less."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col(fp).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    balls = distinct.select(F.col(fp).alias("b"), F.explode(F.concat(F.array(F.col(fp)), flips)).alias("variant"))
    met = balls.withColumn("a", F.min("b").over(Window.partitionBy("variant")))
    return met.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root the smallest node of its component.

    Large-star and small-star steps in turn: each step is a minimum per node, combined before the shuffle, and a join.
    Each round is written to the shared folder; it ends when a round leaves the links as they were.
    """
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # Small star: of each node's links to smaller nodes, the smallest takes the node and the others.
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(smallest, "b")
        edges = written(small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a < b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now


def grouped(rows: DataFrame, least: str, fp: str = "fp") -> DataFrame:
    """(fp, least) of every distinct fingerprint in a component of two or more, with the smallest `least` of the component.

    `least` is a column of rows that orders them; its minimum per fingerprint is combined before the shuffle.
    """
    distinct = written(rows.groupBy(fp).agg(F.min(least).alias(least)), "distinct")
    roots = components(written(links(distinct, fp), "links"))
    member = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    of = written(distinct.join(member.withColumnRenamed("node", fp), fp), "members")
    return of.join(of.groupBy("root").agg(F.min(least).alias("_least")), "root").select(fp, F.col("_least").alias(least)).union(distinct.join(of.select(fp), fp, "left_anti").select(fp, least))


def placed(rows: DataFrame, of: DataFrame, fp: str = "fp") -> DataFrame:
    """rows with the columns of `of`, one row for each fingerprint: the most frequent fingerprints, such as that of texts without words, without a shuffle."""
    often = rows.groupBy(fp).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").orderBy(F.desc("_n"), fp).limit(FREQUENT).select(fp)
    hot = written(of.join(F.broadcast(often), fp), "frequent")
    left = rows.join(F.broadcast(hot.select(fp)), fp, "left_anti")
    return rows.join(F.broadcast(hot), fp).unionByName(left.join(of, fp))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(fingerprints(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    of = written(grouped(docs, "doc_id").withColumnRenamed("doc_id", "component_id"), "grouped")
    return placed(docs, of).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
