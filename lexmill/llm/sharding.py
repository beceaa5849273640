"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard. On each level every child draws -ln(u) / weight from a hash of the row's key
and the child's name, and the smallest draw wins. A child's draw depends on nothing else, so a change of a shard's weight moves
rows only between a subtree on its path and that subtree's siblings: rows stay where they are if they are elsewhere before and after. `grow` adds a
shard in a region of its own, so that one more shard takes rows only into itself, whatever tree it joins.

Law: key. The key and the tree alone decide; `tree(n)` is a fixed tree for each count, and from eight on tree(n + 1) is grow(tree(n)). A null key
is a key of its own, a null text counts as no bytes; repeated rows go to one shard and get slots of their own. Empty tables give empty
results; very long texts are only measured. Other columns pass through, but those named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

#: {region: {rack: {name: (shard, weight)}}}
Tree = dict[str, dict[str, dict[str, tuple[int, float]]]]
#: Shards of a rack, racks of a region, shards of a tree that hasn't grown.
RACK, REGION, PLANTED = 2, 2, 8
#: Groups in which a shard's rows are numbered; their number is fixed, so that slots don't depend on the cluster.
BUCKETS = 4096
SEED = "lexmill"


def tree(shards: int) -> Tree:
    """A tree of shards of weight 1: racks and regions are filled in turn, and shards beyond PLANTED are grown."""
    out: Tree = {}
    for s in range(min(shards, PLANTED)):
        region, rack = s // (RACK * REGION), s // RACK % REGION
        out.setdefault(f"r{region}", {}).setdefault(f"r{region}k{rack}", {})[f"s{s}"] = (s, 1.0)
    for _ in range(PLANTED, shards):
        out = grow(out)
    return out


def shards_of(node) -> list[int]:
    return [node[0]] if isinstance(node, tuple) else [s for child in node.values() for s in shards_of(child)]


def grow(old: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, numbered next, in a region of its own."""
    s = max(shards_of(old), default=-1) + 1
    return old | {f"r+{s}": {f"r+{s}k0": {f"s{s}": (s, weight)}}}


def reweighted(old: Tree, weights: dict[int, float]) -> Tree:
    """The tree with other weights of some shards; a weight of 0 empties a shard."""
    return {r: {k: {name: (s, weights.get(s, w)) for name, (s, w) in rack.items()} for k, rack in racks.items()} for r, racks in old.items()}


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight with u from 52 bits of md5(seed:name:key)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:{name}:"), key).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / 4503599627370496.0) / weight


def weight(node) -> float:
    return node[1] if isinstance(node, tuple) else sum(map(weight, node.values()))


def _winner(key: Column, node) -> Column:
    """The shard below node; only the winning child's own children are drawn."""
    if isinstance(node, tuple):
        return F.lit(node[0])
    node = {name: child for name, child in node.items() if weight(child) > 0}
    if not node:
        raise ValueError("a tree needs a shard with a weight above 0")
    if len(node) == 1:
        return _winner(key, next(iter(node.values())))
    best = F.array_min(F.array(*[F.struct(_draw(key, name, weight(child)).alias("d"), F.lit(i).alias("i")) for i, (name, child) in enumerate(node.items())]))
    children, out = list(node.values()), None
    for i, child in enumerate(children[:-1]):
        out = F.when(best["i"] == i, _winner(key, child)) if out is None else out.when(best["i"] == i, _winner(key, child))
    return out.otherwise(_winner(key, children[-1]))


def _text(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))


def assign(df: DataFrame, key: str, shards: int | Tree, name: str = "shard") -> DataFrame:
    """Adds the shard of each row's key in a tree, or in the fixed tree of so many shards."""
    chosen = _winner(_text(key), tree(shards) if isinstance(shards, int) else shards).cast("int")
    return df.withColumn(name, chosen)


def number(df: DataFrame, shard: str, key: str, order: list[str]) -> DataFrame:
    """Adds slot, gapless from 0 in each shard.

    A shard's rows are dealt over BUCKETS groups by a hash of key and order columns. Equal rows are counted task by task,
    so that a group has a row for each distinct one and task, however often it occurs; groups start where the ones before
    them end. The table of starts has at most shards x BUCKETS rows, whatever the input.
    """
    same = F.concat_ws(":", F.lit(f"{SEED}:slot"), _text(key), *map(_text, order))
    bucket = (F.conv(F.substring(F.md5(same.cast("binary")), 1, 13), 16, 10).cast("long") % BUCKETS).cast("int")
    placed = written(df.withColumns({"_same": same, "_bucket": bucket, "_task": F.spark_partition_id()}), "placed")
    by = [shard, "_bucket", "_same", "_task"]
    n = F.count(F.lit(1)).alias("_n")
    before = lambda *over, by: F.coalesce(F.sum("_n").over(Window.partitionBy(*over).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    copies = placed.groupBy(*by).agg(n, *[F.first(c).alias(f"_{i}") for i, c in enumerate((key, *order))])
    copies = copies.withColumn("_before", before(shard, "_bucket", by=[*(f"_{i}" for i in range(1 + len(order))), "_same", "_task"])).select(*by, "_before")
    starts = placed.groupBy(shard, "_bucket").agg(n).withColumn("_start", before(shard, by=["_bucket"])).drop("_n")
    copy = F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
    numbered = placed.withColumn("_copy", copy).join(copies, by).join(F.broadcast(starts), [shard, "_bucket"])
    return numbered.withColumn("slot", F.col("_start") + F.col("_before") + F.col("_copy") - 1).drop(*by[1:], "_copy", "_before", "_start")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    utf8 = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    placed = assign(assign(docs, "doc_id", 8), "doc_id", 9, "grown_shard")
    return number(placed, "shard", "doc_id", ["size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
