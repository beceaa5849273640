"""The prefix trie of conversations as a Patricia tree built from sorted sequences of turns.

A turn is a token of fixed width, a hash of role and text with the text's code points behind it, so a conversation is one string and prefixes
of turns are prefixes of strings. Conversations are sorted by string and id over all tasks. Neighbours' common prefixes then say where the tree branches: a task goes
through its rows with a stack and makes only points where conversations branch or end, each with the compressed edge above it. Counts, leaves and savings are
added up on these points. The nodes inside an edge have its point's members; their savings are the sums of the edge's suffixes, and Spark expands them.

A point above a task's first or last conversation may have members in other tasks. Of those a task hands on what hangs below it there; the same
stack goes through these few rows (two paths a task) once more, which joins them and makes the branches between tasks. A group of equal conversations may so lie in many
tasks, as may all that begin alike; of the ids that end at a point each task hands on one string.

Rows without conv_id belong to no conversation and are left out. Turns are in order of turn, nulls first; equal turns by their hash, repeated rows side by side. Null roles and
texts are empty. Very long texts are hashed where they are and never moved. A conversation is 40 bytes a turn in one value. Empty tables give no node, not even the root;
columns other than conv_id, turn, role and text don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import conversations, slices, written

#: Hex digits of a turn's hash, of its text's code points, and of both.
HASH, POINTS = 32, 8
WIDTH = HASH + POINTS
#: Conversations a task is planned for.
PLANNED = 200_000
#: Characters of open points' prefixes that are broadcast; beyond, a shuffle joins them.
BROADCAST_CHARS = 32_000_000
#: A conversation takes its first turns, fewer than FIRST, from the first one of its block.
FIRST, BLOCK = 6, 100


def token(role: Column, text: Column) -> Column:
    hashed = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(hashed, 1, HASH), F.lpad(F.lower(F.hex(F.length(text))), POINTS, "0"))


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, key): the tokens of a conversation's turns in order."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = rows.filter("conv_id is not null").select("conv_id", F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"), token(blank("role"), blank("text")).alias("token")).alias("t"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.array_join(F.transform("t", lambda t: t["token"]), "").alias("key"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, key) where the first h turns are those of the first conversation of the block; h by the id's CRC."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % FIRST).cast("int") * WIDTH
    lead = convs.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("block"), F.substring("key", 1, (FIRST - 1) * WIDTH).alias("lead"))
    own = convs.withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("h", h)
    key = F.concat(F.substring(F.coalesce("lead", F.lit("")), F.lit(1), F.col("h")), F.substring(F.col("key"), F.col("h") + 1, F.length("key")))
    return own.join(lead, "block", "left").select("conv_id", key.alias("key"))


def common(a: str, b: str) -> int:
    """How many tokens two keys begin with alike, in characters."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    at = 0
    while a[at : at + WIDTH] == b[at : at + WIDTH]:
        at += WIDTH
    return at


class Point:
    """A point of the tree while conversations below it go by; depth in characters of the key."""

    __slots__ = ("depth", "n", "least", "children", "leaves", "saved", "ids", "below")

    def __init__(self, depth: int):
        self.depth, self.n, self.least, self.children, self.leaves, self.saved, self.ids, self.below = depth, 0, None, 0, 0, 0, [], []

    def add(self, n: int, least: int | None, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        if least is not None:
            self.least = least if self.least is None else min(least, self.least)


def suffix_sums(key: str, top: int, point: Point) -> list[int]:
    """The savings below each node of the edge that ends at point, from the node after top on."""
    total, out = point.saved, []
    for at in range(point.depth, top, -WIDTH):
        total += (point.n - 1) * int(key[at - POINTS : at], 16)
        out.append(total)
    return out[::-1]


class Tree:
    """The stack over sorted keys. `done` gets a point with its key and the depth of the point above once nothing more can come below it in this stream."""

    def __init__(self, done: Callable[[Point, str, Point | None], None]):
        self.stack, self.key, self.done = [Point(0)], "", done

    def close(self, depth: int) -> None:
        """Points deeper than depth are done; one is made there if none is."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth))
            self.done(point, self.key, self.stack[-1])

    def at(self, key: str) -> Point:
        """The point of the next key."""
        if key != self.key:
            self.close(common(self.key, key))
            if self.stack[-1].depth < len(key):
                self.stack.append(Point(len(key)))
            self.key = key
        return self.stack[-1]


_L, _S = T.LongType(), T.StringType()
#: Of a finished point: its key if another task may know it, its parent's key where the parent isn't finished or else the parent's least member.
EDGE = T.StructType([T.StructField("key", _S), T.StructField("parent_key", _S), T.StructField("parent_conv_id", _L), T.StructField("conv_id", _L), T.StructField("top", T.IntegerType()), T.StructField("n", _L), T.StructField("children", _L), T.StructField("leaves", _L), T.StructField("saved", T.ArrayType(_L)), T.StructField("ends", _S)])
#: Of an open point: what a task has below it, other open points left out.
OPEN = T.StructType([T.StructField("open_key", _S), T.StructField("part", T.IntegerType()), T.StructField("own_n", _L), T.StructField("own_least", _L), T.StructField("own_children", _L), T.StructField("own_leaves", _L), T.StructField("own_saved", _L), T.StructField("ids", _S)])
BATCH = 4096


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def edge(point: Point, key: str, top: int, ends: str, known: str | None = None) -> list:
    """A finished point's EDGE without its parent's fields filled in."""
    return [known, None, None, point.least, top // WIDTH, point.n, point.children, point.leaves, suffix_sums(key, top, point), ends]


def finish(point: Point, key: str, above: Point, ends: str, known: str | None = None) -> None:
    """Add a finished point to the one above, which keeps its edge until the least member there is known."""
    point.leaves = point.leaves or 1
    made = edge(point, key, above.depth, ends, known)
    above.add(point.n, point.least, 1, point.leaves, made[8][0])
    above.below.append(made)


def local(rows: DataFrame) -> DataFrame:
    """EDGE of points with all members in one task, and OPEN of the others; rows (key, conv_id, part) are sorted over all tasks."""
    schema = T.StructType([*EDGE, *OPEN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, out, tree, first, part = arrow(schema), [], None, "", 0
        no_open, no_edge = (None,) * len(OPEN), (None,) * len(EDGE)

        def emit_below(point: Point, parent_key: str | None) -> None:
            for made in point.below:
                made[1], made[2] = parent_key, None if parent_key is not None else point.least
                out.append((*made, *no_open))
            point.below = []

        def opened(point: Point, key: str) -> None:
            own = key[: point.depth]
            emit_below(point, own)
            out.append((*no_edge, own, part, point.n, point.least, point.children, point.leaves, point.saved, ",".join(map(str, point.ids)) if point.ids else None))

        def done(point: Point, key: str, above: Point) -> None:
            if first.startswith(key[: point.depth]):
                opened(point, key)
            else:
                finish(point, key, above, hashlib.sha256(",".join(map(str, point.ids)).encode()).hexdigest())
                emit_below(point, None)

        for b in batches:
            for s in slices([b]):
                for key, conv, part in zip(*(s.column(c).to_pylist() for c in ("key", "conv_id", "part")), strict=True):
                    if tree is None:
                        tree, first = Tree(done), key
                    point = tree.at(key)
                    point.ids.append(conv)
                    point.add(1, conv)
                if len(out) >= BATCH:
                    yield batch(out, shape)
                    out.clear()
        if tree is not None:
            while tree.stack:  # all of them lie above the last conversation
                opened(tree.stack.pop(), tree.key)
        yield batch(out, shape)

    return rows.mapInArrow(run, schema)


def between(opened: DataFrame) -> DataFrame:
    """EDGE of the open points: two paths of each task, sorted, through one stack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, out, tree = arrow(EDGE), [], None

        def ended(point: Point) -> str:
            return (point.ids[0] if point.ids else hashlib.sha256()).hexdigest()

        def emit_below(point: Point) -> None:
            for made in point.below:
                made[2] = point.least
                out.append(tuple(made))

        def done(point: Point, key: str, above: Point) -> None:
            finish(point, key, above, ended(point), key[: point.depth])
            emit_below(point)

        for b in batches:
            for s in slices([b], 1):  # the ids of a row may be long
                r = s.to_pylist()[0]
                tree = tree or Tree(done)
                point = tree.at(r["open_key"])
                point.add(r["own_n"], r["own_least"], r["own_children"], r["own_leaves"], r["own_saved"])
                if r["ids"] is not None:
                    if point.ids:
                        point.ids[0].update(b",")
                    else:
                        point.ids.append(hashlib.sha256())
                    point.ids[0].update(r["ids"].encode())
            if len(out) >= BATCH:
                yield batch(out, shape)
                out.clear()
        if tree is not None:
            tree.close(0)
            root = tree.stack[0]
            root.leaves = root.leaves or 1
            emit_below(root)
            out.append(("", None, None, root.least, -1, root.n, root.children, root.leaves, [root.saved], ended(root)))
        yield batch(out, shape)

    return opened.select(*OPEN.names).repartition(1).sortWithinPartitions("open_key", "part").mapInArrow(run, EDGE)


def nodes(convs: DataFrame) -> DataFrame:
    """Every node of the trie of (conv_id, key): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    keys = written(convs.select("conv_id", "key"), "sequences")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count() // PLANNED)
    placed = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())
    found = written(local(placed), "points")
    joints = written(between(found.filter("open_key is not null")), "joints")
    edges = found.filter("open_key is null").select(*EDGE.names)
    known = joints.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("least"))
    small = (joints.agg(F.sum(F.length("key") + 8)).first()[0] or 0) <= BROADCAST_CHARS
    placed_edges = edges.join(F.broadcast(known) if small else known, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "least"))
    whole = placed_edges.select(*EDGE.names).unionByName(joints)
    spread = whole.select("*", F.posexplode("saved").alias("i", "saved_tokens"))
    last = F.col("i") == F.size("saved") - 1
    return spread.select(
        "conv_id", (F.col("top") + 1 + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"), "saved_tokens", F.when(last, F.col("ends")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return nodes(rebuilt(sequences(conversations(spark, sf_dir))))
