"""Size-bounded chunks of free text, with anchors, and their statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.pieces import fit, pack, sentences, slices

TARGET, OVERLAP, LEAST = 800, 200, 80


def generic(docs: DataFrame, id: str = "doc_id", text: str = "text", target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(id, chunk_index, anchor, heading, body): paragraphs cut to pieces and packed, each chunk after the last sentence of the one before."""
    most = target * 3 // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            owners, numbers, groups, bodies = [], [], [], []
            for owner, paragraphs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packed = pack([x for p in paragraphs for x in fit(p, target, least, most)], target, "\n\n", least, most)
                for i, group in enumerate(packed):
                    lead = sentences(packed[i - 1])[-1] if i and overlap else ""
                    owners.append(owner), numbers.append(i), groups.append(group)
                    bodies.append(f"{lead}\n\n{group}" if lead and len(lead) <= overlap and lead != group else group)
            yield pa.RecordBatch.from_arrays([pa.array(owners, b.column(0).type), pa.array(numbers, pa.int32()), pa.array(groups, pa.string()), pa.array(bodies, pa.string())], names=["id", "chunk_index", "own", "body"])

    lines = F.array_join(fn.normalize_lines(F.coalesce(F.col(text), F.lit(""))), "\n")
    paragraphs = F.transform(F.filter(F.split(lines, "\n\n"), lambda p: p != ""), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), paragraphs.alias("paragraphs")).mapInArrow(cut, f"id {kind}, chunk_index int, own string, body string")
    heading = fn.truncate_words(F.substring_index("own", "\n", 1), 120)
    return rows.select(F.col("id").alias(id), "chunk_index", F.concat(F.lit("chunk."), "chunk_index").alias("anchor"), heading.alias("heading"), "body")


#: Runs without Unicode white space, as (?U)\\S+ has them in Java.
_WORD = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def word_balance(docs: DataFrame, chunks: DataFrame, id: str = "doc_id", text: str = "text", body: str = "body") -> DataFrame:
    """(id, words, missing, added, longest) of documents with text: words, how often words are missing from its chunks or added there, and the longest chunk (null: none).

    Texts and chunks meet as they are, once each; words are counted a document at a time and never shuffled."""
    none = F.lit(None).cast("string")
    both = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), none.alias("body")).union(chunks.select(F.col(id), none, F.col(body)))
    met = both.repartition("id").groupBy("id").agg(F.collect_list("text").alias("texts"), F.collect_list("body").alias("bodies"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for texts, bodies in zip(b.column("texts").to_pylist(), b.column("bodies").to_pylist(), strict=True):
                own, cut = (Counter(w for x in some for w in _WORD.findall(x)) for some in (texts, bodies))
                rows.append((own.total(), (own - cut).total(), (cut - own).total(), max(map(len, bodies), default=None)))
            names = ("words", "missing", "added", "longest")
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["id", *names])

    kind = docs.schema[id].dataType.simpleString()
    return met.mapInArrow(count, f"id {kind}, words long, missing long, added long, longest long").withColumnRenamed("id", id)


def stats(chunks: DataFrame, size: Column, source: str = "source", target: int = TARGET) -> DataFrame:
    """Per source: count, least, median, nearest-rank 95th percentile and largest size, and how many exceed target and soft maximum.

    The percentile needs no sort of a source: sizes are counted first, and the few distinct ones are ranked.
    """
    from pyspark.sql import Window

    by_size = chunks.select(source, size.alias("size")).groupBy(source, "size").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(source).orderBy("size"))
    total = F.sum("c").over(Window.partitionBy(source))
    ranked = by_size.withColumns({"upto": upto, "n": total})
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("size")))
    low, high = at(F.floor((F.col("n") + 1) / 2)), at(F.floor(F.col("n") / 2) + 1)
    over = lambda limit: F.coalesce(F.sum(F.when(F.col("size") > limit, F.col("c"))), F.lit(0))
    return ranked.groupBy(source).agg(
        F.sum("c").alias("n_chunks"), F.min("size").alias("min_size"), F.floor((low + high) / 2).alias("median_size"),
        at(F.bround(0.95 * (F.col("n") - 1)) + 1).alias("p95_size"), F.max("size").alias("max_size"), over(target).alias("over_target"), over(target * 3 // 2).alias("over_soft_max"),
    )
