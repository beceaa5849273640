"""Chunks of a whole corpus: every source by its own chunker, in the manifest's order, with metadata and dense ids; and the stored index."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fn
from ..sources.corpus import Settings, exists, manifest_row, read_texts
from ..sources.shared import written
from . import chunking, numbering, structured, vectors

#: What a chunk says about itself beside its text.
METADATA = (
    ("source", "string"), ("source_display", "string"), ("source_kind", "string"), ("doc_type", "string"), ("section_heading", "string"), ("citation", "string"), ("anchor", "string"),
    ("chunk_index", "int"), ("chunk_count", "int"), ("article", "string"), ("part", "string"), ("point", "string"), ("section", "string"), ("form", "string"), ("item", "string"),
    ("subitem", "string"), ("position", "int"), ("appendix", "int"),
)
#: Metrics that a distance can be turned from.
METRICS = ("cosine", "l2", "ip")
#: Sources named in an error.
NAMED = 10


class StructureError(ValueError):
    """A source isn't what its chunker reads, or its chunks can't be told apart."""


def _named(docs: DataFrame) -> list[str]:
    """The chunkers that sources name, no more of them than make an error."""
    return [r[0] for r in docs.select("chunker").distinct().orderBy("chunker").limit(len(structured.CHUNKERS) + 2).collect()]


def chunk_corpus(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(n, pos, text, body, METADATA...) of sources (n, text, source, source_display, source_kind, doc_type, chunker, citation).

    n is a source's place in the manifest. Unknown chunkers are an error; sources without the units of their chunker are found by `broken`.
    """
    names = _named(docs)
    if unknown := [x for x in names if x not in (*structured.CHUNKERS, "generic")]:
        raise StructureError(f"unknown chunker {unknown[0]!r}; known: {sorted((*structured.CHUNKERS, 'generic'))}")
    facts = docs.select(F.col("n").alias("doc_id"), "source", "source_display", "source_kind", "doc_type", "citation")
    parts = []
    for name in names:
        own = docs.filter(F.col("chunker") == name)
        if name == "generic":
            cut = chunking.generic(own.select(F.col("n").alias("doc_id"), "text"), target=settings.chunk_size, overlap=settings.chunk_overlap, least=settings.min_chunk_len)
            part = cut.select("doc_id", F.col("chunk_index").alias("pos"), "anchor", F.col("heading").alias("label"), "body", F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_count")).join(facts, "doc_id")
        else:
            cited = own.select(F.col("n").alias("doc_id"), "text", F.col("citation").alias("prefix"), "source_display", "source_kind")
            made = structured.chunks(cited, name, target=settings.chunk_size, least=settings.min_chunk_len).drop("source_display", "source_kind", "text")
            part = made.join(facts.drop("citation"), "doc_id")
        parts.append(part.withColumns({"n": F.col("doc_id"), "section_heading": F.col("label"), "text": fn.indexed_text(F.col("source_display"), F.col("source_kind"), F.col("label"), F.col("body"))}))
    columns = ["n", "pos", "text", "body", *(f"`{c}`" for c, _ in METADATA)]
    typed = lambda df: df.select("n", "pos", "text", "body", *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in METADATA])
    empty = docs.sparkSession.createDataFrame([], T.StructType.fromDDL("n long, pos int, text string, body string, " + ", ".join(f"{c} {t}" for c, t in METADATA)))
    return reduce(lambda a, b: a.unionByName(b), map(typed, parts), empty).select(*columns)


def broken(docs: DataFrame) -> DataFrame:
    """(n, source, chunker) of sources in which their structured chunker finds none of its units, or units without text."""
    out = [docs.select("n", "source", "chunker").filter(F.lit(False))]
    for name in (x for x in _named(docs) if x in structured.CHUNKERS):
        own = docs.filter(F.col("chunker") == name)
        cited = own.select(F.col("n").alias("doc_id"), "text", F.col("citation").alias("prefix"))
        out.append(structured.unstructured(cited, name).join(own.select(F.col("n").alias("doc_id"), "n", "source", "chunker"), "doc_id").select("n", "source", "chunker"))
    return reduce(lambda a, b: a.union(b), out)


def repeated(chunks: DataFrame) -> DataFrame:
    """(source, anchor, chunk_index, count) of chunks that aren't the only ones of their name."""
    return chunks.groupBy("source", "anchor", "chunk_index").count().filter("count > 1")


def numbered(chunks: DataFrame) -> DataFrame:
    """Adds id: doc_0, doc_1 and so on in the order of sources, places and pieces."""
    placed = numbering.numbered(chunks, "n", "pos", "chunk_index", name="_number")
    return placed.withColumn("id", F.concat(F.lit("doc_"), F.col("_number").cast("string"))).drop("_number")


def checked(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The chunks, or an error that names what is wrong: sources without structure, chunks of one name, no chunk at all."""
    name = lambda rows, *c: ", ".join(" ".join(str(r[x]) for x in c) for r in rows)
    if bad := broken(docs).orderBy("n").limit(NAMED).collect():
        raise StructureError(f"no units found: {name(bad, 'source', 'chunker')}")
    if bad := repeated(chunks).orderBy("source", "anchor", "chunk_index").limit(NAMED).collect():
        raise StructureError(f"chunks that can't be told apart: {name(bad, 'source', 'anchor', 'chunk_index')}")
    if chunks.isEmpty():
        raise StructureError("the corpus has no chunk")
    return chunks


def resolved(path: str, base: str) -> str:
    """Absolute paths and URLs as they are, others below base."""
    return path if path.startswith("/") or "://" in path else f"{base.rstrip('/')}/{path}"


def _listed(entries: list[dict], base: str) -> list[dict]:
    return [manifest_row(e) | {"n": n, "file": resolved(e["path"], base)} for n, e in enumerate(entries)]


_FACTS = ("source", "source_display", "source_kind", "doc_type", "chunker", "citation")


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, "^[a-z]+:/+|^/+", "")


def corpus_docs(spark: SparkSession, entries: list[dict], base: str = ".", places: list[int] | None = None) -> DataFrame:
    """The manifest's sources, or those at some places, with their whole texts."""
    full = [e for e in _listed(entries, base) if places is None or e["n"] in places]
    keys = ("n", "file", *_FACTS)
    listed = spark.createDataFrame([tuple(e[k] for k in keys) for e in full], "n long, file string, " + ", ".join(f"{f} string" for f in _FACTS))
    if not full:
        return listed.drop("file").withColumn("text", F.lit(""))
    texts = read_texts(spark, sorted({e["file"] for e in full})).select(_bare(F.col("path")).alias("file"), "text")
    # An empty file gives no row; a missing one has failed by then.
    return listed.withColumn("file", _bare(F.col("file"))).join(texts, "file", "left").drop("file").withColumn("text", F.coalesce("text", F.lit("")))


def fingerprints(spark: SparkSession, entries: list[dict], base: str = ".", settings: Settings = Settings()) -> DataFrame:
    """(n, source, fingerprint) of the manifest's sources: SHA-256 over what the manifest says of one, the settings of chunks, and the content, hashed where it is."""
    full = _listed(entries, base)
    sizes = f"{settings.chunk_size}|{settings.chunk_overlap}|{settings.min_chunk_len}"
    listed = spark.createDataFrame([(e["n"], e["source"], e["file"], "\u0001".join([*(e[f] for f in _FACTS), sizes])) for e in full], "n long, source string, file string, facts string")
    files = spark.read.format("binaryFile").load(sorted({e["file"] for e in full})).select(_bare(F.col("path")).alias("file"), F.sha2("content", 256).alias("digest"))
    known = listed.withColumn("file", _bare(F.col("file"))).join(files, "file", "left")
    return known.select("n", "source", F.sha2(F.concat_ws("\u0001", "facts", F.coalesce("digest", F.lit(""))), 256).alias("fingerprint"))


def _put(spark: SparkSession, path: str, fill: Callable[[str], None]) -> None:
    """Have a folder filled beside path and renamed to it when whole; of a failed one nothing stays."""
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        fill(staged)
        files.delete(target, True)  # what was there, a failed build's or another tool's
        if not files.rename(source, target):
            raise OSError(f"{staged} could not be renamed to {path}")
    finally:
        files.delete(source, True)


def _fill(spark: SparkSession, staged: str, chunks: DataFrame, docs: DataFrame, known: DataFrame, facts: tuple, embed: Callable[[DataFrame], DataFrame] | None) -> None:
    """Write an index of chunks, check them as they are there, and its info last."""
    numbered(chunks).write.parquet(f"{staged}/chunks")
    stored = checked(spark.read.parquet(f"{staged}/chunks"), docs)
    known.write.parquet(f"{staged}/sources")
    if embed is not None:
        vectors.build(embed(stored.select("id", "text")), f"{staged}/vectors", "id")
    name, *rest = facts
    spark.createDataFrame([(name, stored.count(), *rest)], INFO).write.parquet(f"{staged}/_info")


def _facts(path: str, metric: str, settings: Settings) -> tuple:
    return path, metric, settings.embedding_model, settings.chunk_size, settings.chunk_overlap, settings.min_chunk_len


def load_corpus(spark: SparkSession, entries: list[dict], path: str, base: str = ".", settings: Settings = Settings(), metric: str = "cosine", embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The index of a corpus at `path`, built unless it is there: chunks are written beside it once, checked as they are there, and renamed when whole.

    `embed` gives (id, embedding) of chunks (id, text); with it the index has vectors that `nearest` searches."""
    if not exists(spark, f"{path}/_info"):
        docs = corpus_docs(spark, entries, base)
        known = fingerprints(spark, entries, base, settings)
        _put(spark, path, lambda staged: _fill(spark, staged, chunk_corpus(docs, settings), docs, known, _facts(path, metric, settings), embed))
    return spark.read.parquet(f"{path}/chunks")


def update_corpus(spark: SparkSession, entries: list[dict], path: str, base: str = ".", settings: Settings = Settings(), metric: str = "cosine", embed: Callable[[DataFrame], DataFrame] | None = None) -> list[str]:
    """Bring the index at `path` to the manifest as it is now and say which sources were cut anew: only those that are new or whose text, facts or sizes have changed.

    Chunks of other sources are taken over, wherever the source now stands; ids are dense again, as those of a full build. An index from nothing is built whole."""
    if not exists(spark, f"{path}/_info"):
        load_corpus(spark, entries, path, base, settings, metric, embed)
        return [e["source"] for e in entries]
    now = written(fingerprints(spark, entries, base, settings), "fingerprints")
    before = spark.read.parquet(f"{path}/sources").withColumnRenamed("n", "old_n")
    places = now.join(before, ["source", "fingerprint"], "left").select("n", "old_n", "source").orderBy("n").collect()  # as long as the manifest, which the driver has
    changed = [r for r in places if r["old_n"] is None]
    if not changed and [r["old_n"] for r in places] == list(range(before.count())):
        return []
    docs = corpus_docs(spark, entries, base, [r["n"] for r in changed])
    moved = spark.createDataFrame([(r["old_n"], r["n"]) for r in places if r["old_n"] is not None], "n long, new_n long")
    taken = spark.read.parquet(f"{path}/chunks").drop("id").join(F.broadcast(moved), "n").withColumn("n", F.col("new_n")).drop("new_n")
    chunks = written(taken.unionByName(chunk_corpus(docs, settings)), "chunks")  # read before what it reads is replaced
    _put(spark, path, lambda staged: _fill(spark, staged, chunks, docs, now, _facts(path, metric, settings), embed))
    return [r["source"] for r in changed]


def row_fingerprints(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(n, source, fingerprint) of sources that are rows of a table: SHA-256 over their facts, the settings of chunks, and the text's hash."""
    sizes = f"{settings.chunk_size}|{settings.chunk_overlap}|{settings.min_chunk_len}"
    facts = [F.coalesce(F.col(f), F.lit("")) for f in _FACTS]
    return docs.select("n", "source", F.sha2(F.concat_ws("\u0001", *facts, F.lit(sizes), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 256).alias("fingerprint"))


def update_sources(spark: SparkSession, docs: DataFrame, path: str, settings: Settings = Settings(), metric: str = "cosine", embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`update_corpus` of sources that are rows of a stored table, as `chunk_corpus` takes them, with different n and source: (n, source) of those that were cut anew.

    Neither a list of the sources nor a file for each is held anywhere, so that the work grows with the texts."""
    now = written(row_fingerprints(docs, settings), "fingerprints")
    if not exists(spark, f"{path}/_info"):
        _put(spark, path, lambda staged: _fill(spark, staged, chunk_corpus(docs, settings), docs, now, _facts(path, metric, settings), embed))
        return now.select("n", "source")
    before = spark.read.parquet(f"{path}/sources").withColumnRenamed("n", "old_n")
    places = written(now.join(before, ["source", "fingerprint"], "left").select("n", "old_n", "source"), "places")
    changed = places.filter("old_n is null").select("n", "source")
    if places.filter("old_n is null or old_n <> n").isEmpty() and places.count() == before.count():
        return changed
    own = docs.join(changed.select("n"), "n", "left_semi")
    moved = places.filter("old_n is not null").select(F.col("old_n").alias("n"), F.col("n").alias("new_n"))
    taken = spark.read.parquet(f"{path}/chunks").drop("id").join(moved, "n").withColumn("n", F.col("new_n")).drop("new_n")
    chunks = written(taken.unionByName(chunk_corpus(own, settings)), "chunks")  # read before what it reads is replaced
    _put(spark, path, lambda staged: _fill(spark, staged, chunks, own, now, _facts(path, metric, settings), embed))
    return changed


def nearest(spark: SparkSession, path: str, questions: DataFrame, k: int, exact: bool = False) -> DataFrame:
    """(query_id, distance, rank) with the chunk's id, text and METADATA: the k nearest chunks of questions (query_id, embedding) in the index at `path`."""
    found = vectors.VectorIndex(spark, f"{path}/vectors").search(questions, k, exact=exact)
    return found.join(spark.read.parquet(f"{path}/chunks").select("id", "text", *(f"`{c}`" for c, _ in METADATA)), "id")


INFO = "name string, count long, metric string, embedding_model string, chunk_size int, chunk_overlap int, min_chunk_len int"


def load_documents(spark: SparkSession, file: str, path: str, base: str = ".") -> DataFrame:
    """The index of a single file without a manifest."""
    from ..sources.corpus import single_file

    return load_corpus(spark, [single_file(file)], path, base)


def stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: name, count, metric, model and sizes of an index."""
    return spark.read.schema(INFO).parquet(f"{path}/_info")


def metric(info: DataFrame) -> DataFrame:
    """The metric of an index, null where it is none that distances can be turned from."""
    return info.select(F.when(F.col("metric").isin(*METRICS), F.col("metric")).alias("metric"))


def collection_name(corpus_id: str) -> str:
    return f"corpus_{corpus_id}"


def anchors(chunks: DataFrame) -> DataFrame:
    """(source, articles, parts, points, positions, anchors): how many distinct ones a source has."""
    return chunks.groupBy("source").agg(*[F.countDistinct(c).alias(f"{c}s") for c in ("article", "part", "point", "position", "anchor")])


def oversized(chunks: DataFrame, limit: Column) -> DataFrame:
    """(source, anchor, chunk_index, size) of chunks whose body exceeds a limit, largest first within a source."""
    return chunks.select("source", "anchor", "chunk_index", F.length("body").alias("size")).filter(F.col("size") > limit).sortWithinPartitions("source", F.desc("size"))
