"""Lexical search in blocks of postings with upper bounds.

Documents are read once, in blocks of BLOCK. A block has the postings of its stems and each stem's largest weight. For a query the sum of its weights times these bounds
says what any document of the block can reach: a block that can't reach the query's k-th best score of this task is skipped as a whole, and inside a block only
documents with an essential stem are scored, as those with frequent ones alone can't reach it either. No posting is shuffled; a task keeps k rows a query.

Queries are broadcast in tiles of QUERY_TERMS terms, and the stems' document frequencies up to MOST_STEMS; a corpus with more stems is searched by `tfidf.search`, through shuffles.
Null texts are empty; a text without a stem is no hit and has none. Repeated ids are rows of their own, in the end too. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stems
from ..sources.shared import written
from . import tfidf

#: Documents of a block; terms of a tile of queries (16 bytes each); stems that are broadcast (20 bytes each).
BLOCK, QUERY_TERMS, MOST_STEMS = 2048, 1_000_000, 2_000_000
#: Distances are compared to six digits, so that what is less than this behind may still be as near.
SLACK = 2e-6


def stem_hash(stem: Column, bucketed: bool) -> Column:
    """64 bits of a stem; where terms are buckets the last ones are its bucket."""
    hashed = F.xxhash64(stem)
    return hashed.bitwiseAND(F.lit(~(tfidf.DIMENSIONS - 1))).bitwiseOR(F.crc32(stem.cast("binary")) % (tfidf.DIMENSIONS - 1)) if bucketed else hashed


@dataclass
class Lexicon:
    """Sorted hashes of stems with their idf, and whether terms are buckets."""

    hashes: np.ndarray
    idf: np.ndarray
    bucketed: bool

    def weighed(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, unit weights) of a document's stems."""
        stems_, tf = np.unique(found, return_counts=True)
        at = np.searchsorted(self.hashes, stems_)
        w = (1 + np.log(tf)) * self.idf[at]
        terms = stems_
        if self.bucketed:
            terms, own = np.unique(stems_ & (tfidf.DIMENSIONS - 1), return_inverse=True)
            w = np.bincount(own, weights=w)
        return terms, w / np.sqrt((w * w).sum())


@dataclass
class Queries:
    """Terms and weights of queries, one after the other from `starts` on."""

    ids: list
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    distinct: np.ndarray = field(init=False)
    places: np.ndarray = field(init=False)

    def __post_init__(self):
        self.distinct, self.places = np.unique(self.terms, return_inverse=True)


class Block:
    """Postings of some documents: terms, where each one's begin, documents and weights, and the largest weight."""

    def __init__(self, documents: list[tuple[np.ndarray, np.ndarray]]):
        terms = np.concatenate([t for t, _ in documents])
        owners = np.repeat(np.arange(len(documents)), [len(t) for t, _ in documents])
        order = np.lexsort((owners, terms))
        self.size, self.owners, self.weights = len(documents), owners[order], np.concatenate([w for _, w in documents])[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))
        self.most = np.maximum.reduceat(self.weights, self.starts) if len(terms) else np.zeros(0)


class Search:
    """The best k of each query over the blocks of a task. `touched` counts the postings that were read, `held` those there are for the queries' terms."""

    def __init__(self, queries: Queries, k: int):
        self.q, self.k, self.touched, self.held = queries, k, 0, 0
        self.best: list[tuple[np.ndarray, list]] = [(np.zeros(0), [])] * len(queries.ids)
        self.least = np.full(len(queries.ids), -np.inf)  # what a document has to exceed

    def add(self, block: Block, ids: list) -> None:
        q = self.q
        if not len(q.terms) or not len(block.terms):
            return
        at = np.minimum(np.searchsorted(block.terms, q.distinct), len(block.terms) - 1)
        there = block.terms[at] == q.distinct
        bounds = q.weights * np.where(there, block.most[at], 0.0)[q.places]
        self.held += int(np.where(there, block.ends[at] - block.starts[at], 0)[q.places].sum())
        reach = np.add.reduceat(bounds, q.starts)
        ends = np.append(q.starts[1:], len(q.terms))
        for i in np.flatnonzero((reach > 0) & (reach > self.least - SLACK)):
            of = np.arange(q.starts[i], ends[i])
            of = of[there[q.places[of]]]
            of = of[np.argsort(bounds[of], kind="stable")]
            self._score(i, block, ids, q.weights[of], at[q.places[of]], bounds[of])

    def _score(self, i: int, block: Block, ids: list, weights: np.ndarray, places: np.ndarray, bounds: np.ndarray) -> None:
        """Score the documents of a block that can be among the best; terms come by their bounds, the least first."""
        need = self.least[i] - SLACK
        idle = int(np.searchsorted(np.cumsum(bounds), need, side="right")) if need > 0 else 0  # these together can't reach it
        scores = np.zeros(block.size)
        for w, p in zip(weights[idle:], places[idle:], strict=True):
            s, e = block.starts[p], block.ends[p]
            scores[block.owners[s:e]] += w * block.weights[s:e]
            self.touched += int(e - s)
        live = np.flatnonzero((scores > 0) & (scores + bounds[:idle].sum() > need))
        if not len(live):
            return
        scores = scores[live]
        for w, p in zip(weights[:idle], places[:idle], strict=True):
            s, e = block.starts[p], block.ends[p]
            own = block.owners[s:e]
            found = np.minimum(np.searchsorted(own, live), len(own) - 1)
            hit = own[found] == live
            scores[hit] += w * block.weights[s:e][found[hit]]
            self.touched += int(hit.sum())
        old, names = self.best[i]
        merged, all_ids = np.concatenate([old, scores]), names + [ids[j] for j in live]
        if len(merged) > self.k:
            kth = np.partition(merged, len(merged) - self.k)[len(merged) - self.k]
            keep = np.flatnonzero(merged > kth - SLACK)  # with all that may be as near once distances are rounded
            merged, all_ids = merged[keep], [all_ids[j] for j in keep]
        self.best[i] = (merged, all_ids)
        if len(merged) >= self.k:
            self.least[i] = np.partition(merged, len(merged) - self.k)[len(merged) - self.k]


def tiles(wanted: DataFrame, query: str) -> list[Queries]:
    """The queries' (query, term, w) in tiles; they come to the driver a tile at a time."""
    n = wanted.count()
    count = max(1, -(-n // QUERY_TERMS))
    out = []
    for tile in range(count):
        rows = wanted.filter(F.pmod(F.xxhash64(query), F.lit(count)) == tile).orderBy(query, "term").toArrow()
        ids = rows.column(query).to_pylist()
        starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
        out.append(Queries([ids[i] for i in starts], np.array(starts, dtype=np.int64), rows.column("term").to_numpy().astype(np.int64), rows.column("w").to_numpy()))
    return out


def search(queries: DataFrame, docs: DataFrame, k: int, query: str = "query_id", question: str = "question", doc: str = "doc_id", text: str = "text", bucketed: bool = False) -> DataFrame:
    """(query, doc, distance, rank) of the k documents of least cosine distance that share a term, ties to the smaller id.

    Weights are those of `tfidf.weights`. Query ids must differ."""
    hashes = F.transform(stems(F.coalesce(F.col(text), F.lit(""))), lambda s: stem_hash(s, bucketed))
    held = written(docs.select(doc, hashes.alias("stems")), "stems")
    total = held.count()
    counts = held.select(F.explode(F.array_distinct("stems")).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    counts = written(counts.withColumn("idf", F.log((1 + F.lit(float(total))) / (1 + F.col("df"))) + 1), "lexicon")
    known = written(tfidf.terms(queries, query, question).withColumn("hash", stem_hash(F.col("stem"), bucketed)), "asked")
    if counts.count() > MOST_STEMS:
        terms = tfidf.terms(docs, doc, text)
        idf = tfidf.document_frequency(terms, total)
        return tfidf.search(tfidf.weights(known.drop("hash"), idf, total, query, bucketed), tfidf.weights(terms, idf, total, doc, bucketed), query, doc, k)
    small = known.select("hash").distinct()
    idf = known.select("hash", "stem").distinct().join(counts.join(F.broadcast(small), "hash"), "hash").select("stem", "df", "idf")
    wanted = tfidf.weights(known.drop("hash"), idf, total, query, bucketed)
    wanted = written(wanted.withColumn("term", F.col("term").cast("long") if bucketed else F.xxhash64("term")), "wanted")
    table = counts.orderBy("hash").toArrow()  # MOST_STEMS at most
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(Lexicon(table.column("hash").to_numpy(), table.column("idf").to_numpy(), bucketed))
    types = {f.name: f.dataType.simpleString() for f in [*wanted.schema.fields, *held.schema.fields]}
    found = None
    for queries_ in tiles(wanted, query):
        sent = spark.sparkContext.broadcast(queries_)

        def run(batches, sent=sent):
            state, documents, ids = Search(sent.value, k), [], []

            def flush():
                if documents:
                    state.add(Block(documents), ids)
                    documents.clear()
                    ids.clear()

            for b in batches:
                for name, listed_ in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if len(listed_):
                        documents.append(lexicon.value.weighed(listed_.values.to_numpy(zero_copy_only=False)))
                        ids.append(name)
                    if len(documents) == BLOCK:
                        flush()
            flush()
            for i, (scores, names) in enumerate(state.best):
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array([sent.value.ids[i]] * len(names)), pa.array(names), pa.array(np.round(1 - scores, 6) + 0.0)], names=[query, doc, "distance"])

        part = held.mapInArrow(run, f"`{query}` {types[query]}, `{doc}` {types[doc]}, distance double")
        found = part if found is None else found.union(part)
    by = Window.partitionBy(query).orderBy("distance", doc)
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
