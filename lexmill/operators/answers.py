"""Answering questions in batches: cache, search, gate, context, prompt, sources."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key, source_label
from . import dedup, index, lexical, search

NO_EVIDENCE = "No fragment of the corpus is near enough to answer this question."
#: Finish reasons after which an answer is incomplete, and what is added to it.
INCOMPLETE = {"length": "The answer was cut at the length limit.", "content_filter": "Generation was stopped by a content filter."}


def namespace(corpus_id: str, model: str, top_k: int, prompt_version: str, max_distance: float | None) -> str:
    return f"{corpus_id}|{model}|{top_k}|{prompt_version}|{max_distance}"


def fragment(rank: Column, label: Column, kind: Column, heading: Column, text: Column) -> Column:
    """A numbered fragment of a prompt: a head with its source and kind, its heading, its text."""
    head = F.concat(F.lit("Fragment "), rank.cast("string"), F.lit(" ["), label, F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit(", kind: "), kind)).otherwise(F.lit("")), F.lit("]"))
    return F.concat(head, F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("\nHeading: "), heading)).otherwise(F.lit("")), F.lit("\n"), text, F.lit("\n"))


def prompt_context(hits: DataFrame, query: str = "query_id", rank: str = "kept_rank") -> DataFrame:
    """(query, context): each query's fragments in order of rank, a fixed number of them, joined."""
    label = source_label(F.col("citation"), F.col("source_display"), F.col("source"))
    part = F.struct(F.col(rank).alias("r"), fragment(F.col(rank), label, F.col("source_kind"), F.col("heading"), F.col("text")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"])
    return hits.groupBy(query).agg(F.array_join(ordered, "\n---\n").alias("context"), F.count(F.lit(1)).alias("n_sources"))


def lookup(questions: DataFrame, cache: DataFrame, ns: str, question: str = "question") -> DataFrame:
    """Questions with the cached answer of the same normalised text, null where there is none."""
    keyed = questions.withColumn("query_hash", cache_key(F.lit(ns), F.col(question)))
    return keyed.join(cache.select("query_hash", "answer"), "query_hash", "left")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The newest row of each key; of equal times the row from `fresh`."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return dedup.latest(both, "query_hash", F.desc("created_at"), F.desc("_new"), "answer").drop("_new")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("total"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


#: A stored cache is a folder of parts; the newest row of a key counts.
CACHE = "query_hash string, query string, answer string, context string, created_at timestamp"
#: Parts that are merged into one by the next change.
PARTS = 32


class Cache:
    """A stored answer cache. A change adds a part of its own under a new name, so that writers never take each other's place and nothing is written again.

    Parts are added whole (Spark's commit marks them) and merged when there are many. Of equal times the part that was begun later counts."""

    def __init__(self, spark: SparkSession, path: str, enabled: bool = True):
        self.spark, self.path, self.enabled = spark, path, enabled

    def _files(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self) -> list[str]:
        from ..sources.corpus import exists

        where, files = self._files()
        names = sorted(f.getPath().getName() for f in files.listStatus(where)) if exists(self.spark, self.path) else []
        return [n for n in names if exists(self.spark, f"{self.path}/{n}/_SUCCESS")]

    def _read(self, parts: list[str]) -> DataFrame:
        """The newest row of each key in these parts, with the part's time."""
        read = self.spark.read.schema(f"{CACHE}, part long").parquet(*[f"{self.path}/{n}" for n in parts]) if parts else self.spark.createDataFrame([], f"{CACHE}, part long")
        return dedup.latest(read, "query_hash", F.desc("created_at"), F.desc("part"), "answer")

    def rows(self) -> DataFrame:
        return self._read(self._parts() if self.enabled else []).drop("part")

    def _add(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/{time.time_ns():020}-{uuid.uuid4().hex}")

    def _drop(self, parts: list[str]) -> None:
        where, files = self._files()
        for name in parts:
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, name), True)

    def upsert(self, fresh: DataFrame) -> None:
        if self.enabled:
            names = [f.split()[0] for f in CACHE.split(", ")]
            self._add(fresh.select(*names, F.lit(time.time_ns()).alias("part")))
            if len(self._parts()) > PARTS:
                self.merge()

    def merge(self) -> None:
        """All parts as one. Readers in between find rows twice, which changes nothing; parts that come meanwhile stay."""
        parts = self._parts()
        self._add(self._read(parts))
        self._drop(parts)

    def clear(self) -> None:
        """Forget all answers there are now; a disabled cache is left as it is."""
        if self.enabled:
            self._drop(self._parts())

    def stats(self) -> DataFrame:
        """(total, oldest, newest, enabled, size_mb); zero and null where the cache is disabled. Times are text, to the second."""
        parts = self._parts() if self.enabled else []
        where, files = self._files()
        size = sum(files.getContentSummary(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, n)).getLength() for n in parts)
        each = cache_stats(self.rows()).withColumns({c: shown_time(F.col(c)) for c in ("oldest", "newest")})
        return each.withColumns({"enabled": F.lit(self.enabled), "size_mb": F.round(F.lit(size / 1e6), 2)})


def iso_time(time: Column) -> Column:
    """A timestamp as ISO 8601 text with microseconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def shown_time(time: Column) -> Column:
    """The first 19 characters of the ISO form: to the second."""
    return F.substring(iso_time(time), 1, 19)


def stored_context(context: Column) -> Column:
    """A context as JSON text for the cache, null where it has no fragment."""
    return F.when(F.size(context) > 0, F.to_json(context))


def complete(answer: Column, finish: Column) -> tuple[Column, Column]:
    """(answer with a notice where it is incomplete, whether it may be cached)"""
    notices = F.create_map(*[F.lit(x) for pair in INCOMPLETE.items() for x in pair])
    notice = F.try_element_at(notices, F.coalesce(finish, F.lit("")))
    return F.when(notice.isNull(), answer).otherwise(F.concat(answer, F.lit("\n\n"), notice)), notice.isNull()


def _answered(asked: DataFrame, hits: DataFrame, max_distance: float | None, generate: Callable[[Column], Column]) -> DataFrame:
    """(question_id, outcome, answer, n_sources) of questions looked up in the cache, with the hits (query_id, rank, distance, text and what names their source) of those it lacks."""
    missed = asked.filter(F.col("answer").isNull()).select("question_id", "question")
    judged = search.gate(missed.select(F.col("question_id").alias("query_id")), hits, "cosine", max_distance)
    passed = hits.join(judged.filter("sufficient").select("query_id"), "query_id", "left_semi")
    context = prompt_context(dedup.context(passed.select("query_id", "rank", "text", *NAMED), search.WANTED))
    answered = missed.join(context, missed["question_id"] == context["query_id"], "left")
    made = F.col("context").isNotNull()
    prompt = F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    fresh = answered.select("question_id", F.when(made, "generated").otherwise("no_evidence").alias("outcome"), F.when(made, generate(prompt)).otherwise(NO_EVIDENCE).alias("answer"), F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"))
    cached = asked.filter(F.col("answer").isNotNull()).select("question_id", F.lit("cached").alias("outcome"), "answer", F.lit(0).cast("long").alias("n_sources"))
    return cached.unionByName(fresh)


#: What a fragment says of its source.
NAMED = ("source", "citation", "source_display", "source_kind", "heading")


def ask(spark: SparkSession, questions: DataFrame, docs: DataFrame, cache: DataFrame, ns: str, max_distance: float | None, generate: Callable[[Column], Column]) -> DataFrame:
    """(question_id, outcome, answer, n_sources): cached answers first; the rest are searched, gated and generated from their context.

    questions: question_id, question. docs: doc_id, text, source. generate: the prompt's answer, as a Column.
    """
    asked = lookup(questions, cache, ns)
    missed = asked.filter(F.col("answer").isNull()).select("question_id", "question")
    found = lexical.search(missed.withColumnRenamed("question_id", "query_id"), docs.select("doc_id", "text"), search.CANDIDATES)
    none = F.lit(None).cast("string")
    named = found.join(docs.select("doc_id", "text", "source"), "doc_id").withColumns({c: none for c in NAMED[1:]})
    return _answered(asked, named, max_distance, generate)


def ask_index(spark: SparkSession, questions: DataFrame, path: str, cache: DataFrame, ns: str, max_distance: float | None, generate: Callable[[Column], Column], embed: Callable[..., DataFrame], exact: bool = False) -> DataFrame:
    """As `ask`, over the chunks and vectors of a stored index: fragments have their citation, kind and heading. embed(rows, id, text) gives (id, embedding) as it did for the index."""
    asked = lookup(questions, cache, ns)
    missed = asked.filter(F.col("answer").isNull()).select("question_id", "question")
    vectors = embed(missed, "question_id", "question").withColumnRenamed("question_id", "query_id")
    hits = index.nearest(spark, path, vectors, search.CANDIDATES, exact).withColumnRenamed("section_heading", "heading")
    return _answered(asked, hits, max_distance, generate)


def document_text(*columns: Column) -> Column:
    """A document's text under any of its names: the first that isn't empty."""
    from ..functions.text import first_present

    return F.coalesce(first_present(*columns), F.lit(""))


def sources(context: Column) -> Column:
    """(text, label, heading) of each fragment of a context, an array of structs; a fragment without metadata has no label."""

    def shown(x: Column) -> Column:
        m = x["metadata"]
        label = F.when(m.isNull(), "").otherwise(source_label(m["citation"], m["source_display"], m["source"]))
        return F.struct(x["text"].alias("text"), label.alias("label"), F.trim(F.coalesce(m["section_heading"], F.lit(""))).alias("heading"))

    return F.transform(context, shown)


CONTEXT = "array<struct<text:string,id:string,metadata:struct<citation:string,source_display:string,source:string,source_kind:string,section_heading:string>>>"


def cached_context(json: Column) -> Column:
    """A stored context, a JSON array of texts or of objects with a text; other items are dropped, and an empty one is null."""
    items = F.from_json(json, "array<string>")
    plain = F.lit(None).cast(CONTEXT)

    def read(x: Column) -> Column:
        whole = F.element_at(F.from_json(F.concat(F.lit("["), x, F.lit("]")), CONTEXT), 1)
        bare = F.element_at(F.from_json(F.to_json(F.array(F.struct(x.alias("text")))), CONTEXT), 1)
        return F.when(x.startswith("{"), whole).otherwise(bare)

    kept = F.filter(F.transform(items, read), lambda x: x["text"].isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(plain)


def log_fields(results: DataFrame, model: str, top_k: int) -> DataFrame:
    """What the journal gets of results (outcome, answer, model, sources): no model where nothing was found, the configured one where none is named."""
    named = F.when(F.col("outcome") == "no_evidence", F.lit(None).cast("string")).otherwise(F.coalesce("model", F.lit(model)))
    return results.withColumns({
        "response": F.col("answer"), "from_cache": F.col("outcome") == "cached", "model": named, "top_k": F.lit(top_k), "sources_count": F.size(F.coalesce("sources", F.array())),
    })
