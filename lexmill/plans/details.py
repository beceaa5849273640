"""Queries of the smaller operators: shown texts, headers, sentences, matches, log fields, numbering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.pieces import ABBREVIATIONS, sentences
from ..operators import answers, evaluate, journal
from ..sources import corpus, remote
from .catalogue import _KNN, _hits, query, table


@query(r"""select doc_id, md5(case when length(text) > 220 then regexp_replace(substr(text, 1, 220), '\s+$', '') || '…' else text end) as preview,
md5(case when length(text) <= 120 then text else regexp_replace(regexp_replace(substr(text, 1, 120), '^(.*) [^ ]*$', '\1', 's'), '[,;:\- ]+$', '') || '…' end) as heading,
text = upper(text) and regexp_matches(text, '\p{L}') as capitals from documents""")
def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews, headings cut at a word, and whether a text is all capitals."""
    t = F.col("text")
    digest = lambda c, name: F.md5(c.cast("binary")).alias(name)
    return table(spark, sf_dir, "documents").select("doc_id", digest(fn.preview(t), "preview"), digest(fn.truncate_words(t, 120), "heading"), fn.is_all_caps(t).alias("capitals"))


@query("""select doc_id, md5('[Источник: ' || source || ' | ' || case lang when 'en' then 'закон РФ' when 'de' then 'закон о закупках' else lang end || ']' || chr(10) || '[Фрагмент: ' || lang || ']' || chr(10) || chr(10) || text) as digest from documents""")
def chunk_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search sees of a chunk: source, kind and label before the text."""
    kind = F.when(F.col("lang") == "en", "law").when(F.col("lang") == "de", "procurement_law").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fn.indexed_text(F.col("source"), kind, F.col("lang"), F.col("text")).cast("binary")).alias("digest"))


_ENDS = rf"""with k as (select doc_id, regexp_extract_all(text, '\S+') as w from documents),
t as (select doc_id, i, w[i] as tok, w[i + 1] as nxt from (select doc_id, w, unnest(range(1, len(w)::int + 1)) as i from k)),
b as (select *, regexp_replace(tok, '["»”)\]]+$', '') as bare from t),
c as (select *, regexp_extract(bare, '[.!?…]+$') as stops, lower(ltrim(regexp_replace(bare, '[.!?…]+$', ''), '(«"“[')) as core from b),
e as (select doc_id, coalesce(stops <> '' and regexp_matches(nxt, '^[\p{{Lu}}\p{{Nd}}(«"“\[]') and not (stops[1] = '.' and
  (core in ({", ".join(f"'{a}'" for a in sorted(ABBREVIATIONS))}) or regexp_full_match(core, '\p{{L}}(\.\p{{L}})*') or i = 1 and regexp_full_match(core, '[0-9.]+'))), false) as ends from c)
select d.doc_id, coalesce(n, 0) as n_sentences from documents d left join (select doc_id, 1 + count(*) filter (ends) as n from e group by doc_id) using (doc_id)"""


@query(_ENDS)
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: len(sentences(x or "")))

    return table(spark, sf_dir, "documents").select("doc_id", count("text").alias("n_sentences"))


@query(f"""with {_KNN} select query_id, coalesce(min(rank) filter (h.label = e.label and h.vec_id <> h.query_id), 0) as rank from hits h join embeddings e on e.vec_id = h.query_id group by query_id""")
def expected_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of each query's first hit of the label that is expected of it, 0 if there is none."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _hits(spark, sf_dir).filter("vec_id <> query_id").join(vectors, "vec_id")
    expected = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.lit(None).cast("string").alias("anchor"))
    found = evaluate.first_match(hits.withColumn("anchor", F.lit("any")), expected, ["label", "anchor"])
    return found.select("query_id", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))


@query(f"""with {_KNN}, b as (select query_id, min(distance) as best from hits where vec_id <> query_id group by query_id)
select round(max(best) filter (query_id % 40 = 0), 6) as worst_in_scope, round(min(best) filter (query_id % 40 <> 0), 6) as best_out_of_scope from b""")
def gate_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst best distance in scope and the best out of scope; half of the queries stand for either."""
    best = _hits(spark, sf_dir).filter("vec_id <> query_id").groupBy("query_id").agg(F.min("distance").alias("best_distance")).withColumn("in_scope", F.col("query_id") % 40 == 0)
    found = evaluate.margin(best)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("""with q as (select conv_id, list(text order by turn) filter (role = 'user') as q, list(text order by turn) filter (role <> 'user') as a from conversations group by conv_id)
select conv_id, unnest(range(1, len(q)::int + 1)) as place, md5(unnest(q) || ' / ' || unnest(a)) as pair from q where len(q) = len(a)""")
def questions_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and reference answers by position."""
    each = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("turn", "text")))), lambda x: x["text"])
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(each(F.col("role") == "user").alias("q"), each(F.col("role") != "user").alias("a"))
    pairs = lists.filter(F.size("q") == F.size("a")).select("conv_id", F.posexplode(evaluate.with_truth(F.col("q"), F.col("a"))).alias("place", "x"))
    return pairs.select("conv_id", (F.col("place") + 1).cast("long").alias("place"), F.md5(F.concat(F.col("x")["question"], F.lit(" / "), F.col("x")["ground_truth"]).cast("binary")).alias("pair"))


_FINISH = "case turn % 3 when 0 then 'stop' when 1 then 'length' else 'content_filter' end"


@query(f"""select conv_id, turn, md5(text || case {_FINISH} when 'length' then chr(10) || chr(10) || '{answers.INCOMPLETE["length"]}' when 'content_filter' then chr(10) || chr(10) || '{answers.INCOMPLETE["content_filter"]}' else '' end) as digest,
{_FINISH} = 'stop' as may_cache from conversations""")
def incomplete_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a notice of what cut them, which aren't cached."""
    answer, cached = answers.complete(F.col("text"), F.expr(_FINISH))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(answer.cast("binary")).alias("digest"), cached.alias("may_cache"))


@query("""select conv_id, turn, case turn % 3 when 0 then 'cached' when 1 then 'generated' else 'no_evidence' end = 'cached' as from_cache, case when turn % 3 = 2 then null when turn % 2 = 0 then 'named' else 'configured' end as model,
5 as top_k, turn % 3 as sources_count, md5(text) as response from conversations""")
def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the journal gets of results."""
    third = F.col("turn") % 3
    results = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(third == 0, "cached").when(third == 1, "generated").otherwise("no_evidence").alias("outcome"), F.col("text").alias("answer"),
        F.when(F.col("turn") % 2 == 0, "named").alias("model"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, third.cast("int")).alias("sources"),
    )
    found = answers.log_fields(results, "configured", 5)
    return found.select("conv_id", "turn", "from_cache", "model", "top_k", F.col("sources_count").cast("long").alias("sources_count"), F.md5(F.col("response").cast("binary")).alias("response"))


@query("select event_id, row_number() over (order by ts, event_id::varchar) + 100 as number from events")
def journal_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows are numbered on from the journal's last id, by time."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), F.col("event_id").cast("string").alias("query"))
    return journal.numbered(rows, 100).select("event_id", "number")


@query(r"""with e as (select event_id, repeat('x', (event_id % 3)::int * 600) || ' token=' || event_type || ' end' as t from events), r as (select event_id, regexp_replace(t, 'token=\S+', 'token=[REDACTED]') as t from e)
select event_id, md5(case when length(t) > 1000 then substr(t, 1, 1000) || '…' else t end) as digest from r""")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted first, then cut."""
    text = F.concat(F.repeat(F.lit("x"), (F.col("event_id") % 3 * 600).cast("int")), F.lit(" token="), "event_type", F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", F.md5(fn.error_message(text).cast("binary")).alias("digest"))


@query("select item_id, length(text)::double as length, 1.0::double as one from benchmark")
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service that answers in any order: vectors go back to their texts by index."""
    made = remote.embed(table(spark, sf_dir, "benchmark").select("item_id", "text"), _service, batch=7)
    return made.select("item_id", F.get("embedding", F.lit(0)).cast("double").alias("length"), F.get("embedding", F.lit(1)).cast("double").alias("one"))


def _service(texts: list[str]) -> list[tuple[int, list[float]]]:
    return [(i, [float(len(x)), 1.0]) for i, x in reversed(list(enumerate(texts)))]


@query("""with t as (select conv_id, text, role, turn from conversations) select conv_id, turn, case when turn % 4 = 0 then '' when turn % 4 = 1 then role || ' ' || turn when turn % 4 = 2 then role else 'источник' end as label, md5(text) as digest from t""")
def context_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and label of fragments, by the first name that a fragment's metadata has; none without metadata."""
    fourth, none = F.col("turn") % 4, F.lit(None).cast("string")
    meta = F.when(fourth != 0, F.struct(F.when(fourth == 1, F.concat_ws(" ", "role", "turn")).alias("citation"), F.lit("").alias("source_display"), F.when(fourth == 2, F.col("role")).alias("source"), none.alias("source_kind"), none.alias("section_heading")))
    context = F.array(F.struct("text", none.alias("id"), meta.alias("metadata")))
    back = answers.cached_context(answers.stored_context(context))  # as the cache keeps it
    shown = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.inline(answers.sources(back)))
    return shown.select("conv_id", "turn", "label", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("select source, count(*) as n, min(doc_id) as first from documents group by source")
def manifest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each source, the one of smallest id, with the source's size."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    from ..operators.dedup import latest

    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    return latest(docs.withColumn("n", n), "source", F.asc("doc_id")).select("source", "n", F.col("doc_id").alias("first"))


@query("select doc_id, md5(text) as digest from documents")
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index is read as it was built, and not built again."""
    import uuid

    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/index-{uuid.uuid4().hex}"
    corpus.build_index(docs, path)
    return corpus.build_index(docs.limit(0), path)
