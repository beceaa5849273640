"""Exact self-join of sets by Jaccard similarity: a prefix filter with positions and length bands.

Tokens of all sets are put in one order, rare ones first. Two sets of similarity t share a token among the first n - ceil(t n) + 1 of the larger and the first
n - ceil(2 t / (1 + t) n) + 1 of the smaller; at their first common token the tokens left on both sides must still suffice for the overlap that t asks for,
and no size may be below t times the other. Of sets that meet so, those are compared as a whole whose tokens, counted in bins, can overlap enough. Any order of tokens gives the same result; it matters for the work alone, so it comes
from a sample: sets of one template share frequent tokens, which stand last, and don't meet unless what is their own is alike too.

Sets that are equal are one class, however many rows have them. Joins are on rare tokens and left to Spark to split. Sets themselves are written once, and only those of pairs to be compared are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

SHINGLE, SIMILARITY = 5, 0.8
#: One set in so many tells which tokens are frequent: those of LEAST sets or more there, the MOST first ones (8 MB in every task).
SAMPLE, LEAST, MOST = 16, 4, 1_000_000
#: Bins that tokens are counted in, the largest count, and how many sets to be compared are told to all tasks; more of them meet their sets in a shuffle.
BINS, FULL, TOLD = 256, 65_535, 1_000_000
_SLACK = 1e-9


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """The distinct hashes of n words in a row, A-Z lower-cased; fewer words are one shingle, no words none; null counts as empty."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, n)))
    return bind(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(hashed(w)))))


def probe_length(n: int, t: float) -> int:
    """How many first tokens of a set of n another one that isn't larger has to share one of."""
    return n - math.ceil(t * n - _SLACK) + 1 if n else 0


def index_length(n: int, t: float) -> int:
    """The same for another set that isn't smaller."""
    return n - math.ceil(2 * t / (1 + t) * n - _SLACK) + 1 if n else 0


@dataclass
class Order:
    """Frequent tokens, sorted, and the place of each among them by frequency; all others stand before them by their hash."""

    tokens: np.ndarray
    places: np.ndarray

    def arranged(self, tokens: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens in this order, and which of them are frequent."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), max(len(self.tokens) - 1, 0))
        frequent = self.tokens[at] == tokens if len(self.tokens) else np.zeros(len(tokens), dtype=bool)
        place = np.where(frequent, self.places[at], -1) if len(self.tokens) else np.full(len(tokens), -1)
        order = np.lexsort((tokens, place))[:first]
        return tokens[order], frequent[order]


def order_of(sampled: DataFrame) -> Order:
    """The order by (token) of sampled sets."""
    counts = sampled.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "token").limit(MOST).toPandas()
    tokens = counts["token"].to_numpy(dtype=np.int64)
    by = np.argsort(tokens)
    return Order(tokens[by], (len(tokens) - np.arange(len(tokens)))[by])


def in_sample(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(SAMPLE)) == 0


def signatures(sets: DataFrame, order: Order, t: float = SIMILARITY) -> DataFrame:
    """(node, size, first, bins) of sets (node, tokens): the first tokens in their order, and how many of all tokens are in each bin."""
    held = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        for b in batches:
            firsts, sizes, bins = [np.zeros(0, dtype=np.int64)], [], []
            for found in b.column("tokens"):
                values = found.values.to_numpy(zero_copy_only=False) if found.is_valid else np.zeros(0, dtype=np.int64)
                firsts.append(order.arranged(values, probe_length(len(values), t))[0])
                sizes.append(len(values))
                bins.append(np.minimum(np.bincount(values & (BINS - 1), minlength=BINS), FULL).astype("<u2").tobytes())
            ends = np.cumsum([len(f) for f in firsts])
            made = [pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts))), pa.array(bins, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("node"), *made], names=["node", "size", "first", "bins"])

    return sets.select("node", "tokens").mapInArrow(run, "node long, size int, first array<long>, bins binary")


def placed(signed: DataFrame) -> DataFrame:
    """(token, node, size, pos) of the first tokens of signatures."""
    return signed.select("node", "size", F.posexplode("first").alias("pos", "token")).select("token", "node", "size", "pos")


def prefixes(sets: DataFrame, order: Order, t: float = SIMILARITY) -> DataFrame:
    """(token, node, size, pos) of the first tokens of sets (node, tokens)."""
    return placed(signatures(sets, order, t))


def fits(small: Column, large: Column, t: float = SIMILARITY) -> Column:
    """Whether two places (size, pos) of a common token may belong to similar sets; small's set isn't the larger one."""
    n, m, i, j = small["size"], large["size"], small["pos"], large["pos"]
    indexed = i < n - F.ceil(F.lit(2 * t / (1 + t)) * n - _SLACK) + 1
    needed = F.ceil(F.lit(t / (1 + t)) * (n + m) - _SLACK)
    return (n >= t * m - _SLACK) & indexed & (1 + F.least(n - i - 1, m - j - 1) >= needed)


def candidates(rows: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of nodes, a the set that isn't larger (of equal sizes the smaller node), that may be similar; rows as `prefixes` gives them."""
    # Rows unfold from few bytes on disk, by which Spark would broadcast them.
    placed = rows.select("token", F.struct("size", "node", "pos").alias("at")).hint("merge")
    x, y = F.col("x.at"), F.col("y.at")
    met = placed.alias("x").join(placed.alias("y"), (F.col("x.token") == F.col("y.token")) & (x < y) & fits(x, y, t))
    return met.filter(x["node"] != y["node"]).select(x["node"].alias("a"), y["node"].alias("b")).distinct()


def alike(pairs: DataFrame, signed: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose bins can hold the overlap that t asks for; none of similarity t is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u2").reshape(-1, BINS) for c in ("x", "y")]
            most = np.minimum(*counts).sum(axis=1, dtype=np.int64)
            n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            fit = (most >= np.ceil(t / (1 + t) * (n + m) - _SLACK)) | (np.minimum(n, m) > FULL)  # a bin may be full there
            yield b.select(["a", "b"]).filter(pa.array(fit))

    of = lambda key, bins, size: signed.select(F.col("node").alias(key), F.col("bins").alias(bins), F.col("size").alias(size))
    both = pairs.join(of("a", "x", "n"), "a").join(of("b", "y", "m"), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def of_nodes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of nodes (node), some of which may repeat; other sets may stay where the nodes are too many to be told."""
    told = nodes.distinct()
    return sets.join(F.broadcast(told), "node", "left_semi") if told.count() <= TOLD else sets


def verified(pairs: DataFrame, sets: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of the pairs that are similar."""
    of = lambda key, name: of_nodes(sets, pairs.select(F.col(key).alias("node"))).select(F.col("node").alias(key), F.col("tokens").alias(name))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").withColumn("overlap", F.size(F.array_intersect("x", "y")))
    return both.select("a", "b", (F.col("overlap") / (F.size("x") + F.size("y") - F.col("overlap"))).alias("similarity")).filter(F.col("similarity") >= t - _SLACK)


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, t: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Members (id, node) and links (a, b, similarity) between nodes.

    A node stands for all rows with one set of n-word shingles; texts without words are one node without links. Ids may repeat and be null. Empty tables give empty results."""
    rows = written(docs.select(F.col(id).alias("id"), shingles(F.col(text), n).alias("tokens")).withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.md5(F.concat_ws(",", "tokens").cast("binary"))), "sets")
    nodes = written(rows.groupBy("key").agg(F.min("row").alias("node")), "nodes")
    sets, only = rows.select(F.col("row").alias("node"), "tokens", "key"), nodes.select("node")
    order = order_of(sets.filter(in_sample(F.col("key"))).join(only, "node", "left_semi").select(F.explode("tokens").alias("token")))
    # Rows of equal sets are told apart by their signatures, which are small.
    signed = written(signatures(sets, order, t).join(only, "node", "left_semi"), "signatures")
    links = written(verified(written(alike(candidates(placed(signed), t), signed, t), "candidates"), sets.drop("key"), t), "links")
    return rows.select("id", "key").join(nodes, "key").select(F.col("id").alias(id), "node"), links


def linked(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, t: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size, n_links, linked_rows, best) of every row: its class (smallest id), the classes similar to it, their rows, and the highest similarity."""
    members, links = join(docs, id, text, n, t)
    classes = written(members.groupBy("node").agg(F.min(id).alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    both = links.select("a", "b", "similarity").union(links.select("b", "a", "similarity"))
    sizes = classes.select(F.col("node").alias("b"), F.col("class_size").alias("rows"))
    found = both.join(sizes, "b").groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"), F.sum("rows").alias("linked_rows"), F.round(F.max("similarity"), 9).alias("best"))
    facts = classes.join(found, "node", "left").select("node", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("linked_rows", F.lit(0)).alias("linked_rows"), "best")
    return members.join(facts, "node").drop("node")
