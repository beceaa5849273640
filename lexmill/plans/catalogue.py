"""The queries of the engine's own operators and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import answers, chunking, dedup, evaluate, journal, lexical, sanitize, search, tfidf
from ..sources import corpus

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A question's best hit must be this near.
MAX_DISTANCE = 0.75
NAMESPACE = answers.namespace("corpus", "model", search.WANTED, "v1", MAX_DISTANCE)


def query(sql: str | None = None):
    """Registers a query under its name, with the same in SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Search: every vector whose id is divisible by 20 asks.

_KNN = """q as (select vec_id as query_id, embedding::double[] as qv from embeddings where vec_id % 20 = 0),
d as (select query_id, vec_id, label, round(1 - list_cosine_similarity(qv, embedding::double[]), 9) as distance from q, embeddings),
hits as (select * from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d) where rank <= 15)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(f"with {_KNN} select query_id, vec_id, round(distance, 6) as distance, rank from hits")
def knn_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {_KNN}, p as (select h.query_id, h.vec_id, q.embedding::double[] as x, v.embedding::double[] as y from hits h join embeddings q on q.vec_id = h.query_id join embeddings v on v.vec_id = h.vec_id),
m as (select query_id, vec_id, unnest(['cosine', 'ip', 'l2']) as metric, unnest([1 - list_cosine_similarity(x, y), 1 - list_inner_product(x, y), list_distance(x, y) ** 2 / 2]) as d from p)
select query_id, vec_id, metric, round(d, 5) + 0.0 as cosine_distance from m""")
def knn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits measured under each metric from their vectors, as cosine distances."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("y"))
    pairs = _hits(spark, sf_dir).join(vectors, "vec_id").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("y").alias("x")), "query_id")
    total = lambda a, b, f: F.aggregate(F.zip_with(a, b, lambda s, t: f(s.cast("double"), t.cast("double"))), F.lit(0.0), lambda s, t: s + t)
    dot = lambda a, b: total(a, b, lambda s, t: s * t)
    raw = {"cosine": 1 - dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y")), "ip": 1 - dot("x", "y"), "l2": total("x", "y", lambda s, t: (s - t) * (s - t))}
    each = pairs.select("query_id", "vec_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), d.alias("raw")) for m, d in raw.items()])))
    return each.select("query_id", "vec_id", "metric", (F.round(fn.cosine_distance(F.col("raw"), F.col("metric")), 5) + 0.0).alias("cosine_distance"))


@query(f"""with {_KNN} select query_id, min(distance) filter (vec_id <> query_id) <= {MAX_DISTANCE} as sufficient, round(min(distance) filter (vec_id <> query_id), 6) as best_distance,
case when min(distance) filter (vec_id <> query_id) <= {MAX_DISTANCE} then 'ok' else 'too_far' end as reason from hits group by query_id""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector decides whether there is evidence."""
    hits = _hits(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"))
    judged = search.gate(asked, hits.filter("vec_id <> query_id"), "cosine", MAX_DISTANCE)
    return judged.withColumn("best_distance", F.round("best_distance", 6))


@query(f"""with {_KNN}, r as (select h.query_id, min(rank - 1) filter (h.label = e.label and h.vec_id <> h.query_id) as rank from hits h join embeddings e on e.vec_id = h.query_id group by h.query_id)
select avg(case when rank <= 1 then 1 else 0 end) as hit1, avg(case when rank <= 3 then 1 else 0 end) as hit3, avg(case when rank <= 5 then 1 else 0 end) as hit5 from r""")
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit is another vector of the same label."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    named = _hits(spark, sf_dir).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    match = (F.col("label") == F.col("wanted")) & (F.col("vec_id") != F.col("query_id"))
    return search.hit_at(named.groupBy("query_id").agg(F.min(F.when(match, F.col("rank") - 1)).alias("rank")), "rank")


# Texts: normal forms, duplicates, chunks.

_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


@query(f"""with n as (select doc_id, source, {_NORM.format('text')} as t from documents)
select doc_id, source from n where t = '' or doc_id in (select min(doc_id) from n where t <> '' group by t)""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact(table(spark, sf_dir, "documents")).select("doc_id", "source")


@query(r"""with l as (select doc_id, list_transform(string_split(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x{00A0}\x{2007}\x{2009}\x{202F}]+', ' ', 'g'))) as a from documents),
k as (select doc_id, list_filter(a, lambda x, i: x <> '' or (i > 1 and a[i - 1] <> '')) as a from l),
e as (select doc_id, case when len(a) > 0 and a[len(a)] = '' then a[1:len(a) - 1] else a end as a from k)
select doc_id, len(a) as n_lines, md5(array_to_string(a, chr(10))) as digest from e""")
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", fn.normalize_lines(F.col("text")).alias("a"))
    return lines.select("doc_id", F.size("a").cast("long").alias("n_lines"), F.md5(F.array_join("a", "\n").cast("binary")).alias("digest"))


@query()
def chunk_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.generic(table(spark, sf_dir, "documents"))


_WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda x: x <> ''))"


@query(rf"select doc_id, count(w) as words, 0 as missing, 0 as added from (select doc_id, unnest(case when text = '' then [null] else string_split_regex(text, '\s+') end) as w from documents) where w is null or w <> '' group by doc_id")
def word_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multisets of a document's words and of its chunks' words without overlap: how often words are missing or added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = chunking.word_balance(docs, chunking.generic(docs, overlap=0))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", zero("words"), zero("missing").cast("int"), zero("added").cast("int"))


@query("""with s as (select source, length(text) as size from documents), r as (select *, row_number() over (partition by source order by size) as i, count(*) over (partition by source) as n from s)
select source, count(*) as n_chunks, min(size) as min_size, floor(median(size))::bigint as median_size, min(size) filter (i >= round_even(0.95 * (n - 1), 0) + 1) as p95_size, max(size) as max_size,
count(*) filter (size > 800) as over_target, count(*) filter (size > 1200) as over_soft_max from r group by source""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of whole documents; corpus_chunk_stats has those of chunks."""
    long = ("min_size", "p95_size", "max_size")
    return chunking.stats(table(spark, sf_dir, "documents"), F.length("text")).withColumns({c: F.col(c).cast("long") for c in long})


@query()
def corpus_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.generic(docs).join(docs.select("doc_id", "source"), "doc_id")
    return chunking.stats(chunks, F.length("body"))


_INJECTED = "text || ' sk-abcd1234 Bearer abcdefgh12345 api_key=topsecret1 http://user:pass@host/x'"


@query(rf"""with i as (select doc_id, {_INJECTED} as t from documents),
a as (select doc_id, regexp_replace(t, '(^|[^A-Za-z0-9])sk-[A-Za-z0-9_\-*.]{{4,}}', '\1[REDACTED]', 'g') as t from i),
b as (select doc_id, regexp_replace(t, '\b[Bb][Ee][Aa][Rr][Ee][Rr]\s+[A-Za-z0-9._~+/=\-]{{8,}}', 'Bearer [REDACTED]', 'g') as t from a),
c as (select doc_id, regexp_replace(t, '(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|token|secret|password|passwd)\b(\s*[=:]\s*)[^\s,;''"&]+', '\1\2[REDACTED]', 'g') as t from b)
select doc_id, md5(regexp_replace(t, '://[^/\s:@]+:[^/\s@]+@', '://[REDACTED]@', 'g')) as digest from c""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    literals = F.lit(_INJECTED.split("'")[1])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fn.redact(F.concat("text", literals)).cast("binary")).alias("digest"))


# Lexical search: the benchmark's texts ask, documents answer.

_STEMS = """list_transform(list_filter(regexp_extract_all(replace(lower({0}), 'ё', 'е'), '[а-яёa-z0-9]+'), lambda w: length(w) > 2 and not list_contains([%s], w)), lambda w: substr(w, 1, 5))""" % ", ".join(f"'{w}'" for w in fn.STOP_WORDS)
_TERMS = f"""dt as (select doc_id, stem, count(*) as tf from (select doc_id, unnest({_STEMS.format('text')}) as stem from documents) group by all),
n as (select count(*)::double as n from documents), df as (select stem, count(*) as df, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 as idf from dt, n group by stem)"""


@query(f"with {_TERMS} select stem, df, round(idf, 6) as idf from df")
def tfidf_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tfidf.document_frequency(tfidf.terms(docs, "doc_id", "text"), docs.count()).withColumn("idf", F.round("idf", 6))


def _lexical(spark: SparkSession, sf_dir: str, bucketed: bool, k: int = search.CANDIDATES) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k, "item_id", "text", bucketed=bucketed)


@query(f"""with {_TERMS}, qt as (select item_id, stem, count(*) as tf from (select item_id, unnest({_STEMS.format('text')}) as stem from benchmark) group by all),
dw as (select doc_id, stem, (1 + ln(tf)) * idf as w from dt join df using (stem)), dn as (select doc_id, sqrt(sum(w * w)) as norm from dw group by doc_id),
qw as (select item_id, qt.stem, (1 + ln(tf)) * coalesce(idf, ln(1 + n.n) + 1) as w from qt left join df using (stem), n), qn as (select item_id, sqrt(sum(w * w)) as norm from qw group by item_id),
s as (select item_id, doc_id, round(1 - sum(qw.w * dw.w / qn.norm / dn.norm), 6) as distance from qw join qn using (item_id) join dw using (stem) join dn using (doc_id) group by all)
select item_id, doc_id, distance, rank from (select *, row_number() over (partition by item_id order by distance, doc_id) as rank from s) where rank <= 15""")
def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, False).withColumn("rank", F.col("rank").cast("long"))


def crc_sql(of: str) -> str:
    """CRC-32 of a text in DuckDB: 256 remainders by its rule (eight times, halve, and add the polynomial where a bit falls out), then a fold over bytes."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    byte = f"list_transform(regexp_extract_all(hex(encode({of})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda a, b: xor(a >> 8, ({table}::bigint[])[(xor(a, b) & 255) + 1])), 4294967295::bigint)"


@query(f"""with {_TERMS}, qt as (select item_id, stem, count(*) as tf from (select item_id, unnest({_STEMS.format('text')}) as stem from benchmark) group by all),
b as (select stem, {crc_sql('stem')} % {tfidf.DIMENSIONS - 1} as term from (select stem from df union select stem from qt)),
dw as (select doc_id, term, sum((1 + ln(tf)) * idf) as w from dt join df using (stem) join b using (stem) group by all), dn as (select doc_id, sqrt(sum(w * w)) as norm from dw group by doc_id),
qw as (select item_id, term, sum((1 + ln(tf)) * coalesce(idf, ln(1 + n.n) + 1)) as w from qt left join df using (stem) join b using (stem), n group by all), qn as (select item_id, sqrt(sum(w * w)) as norm from qw group by item_id),
s as (select item_id, doc_id, round(1 - sum(qw.w * dw.w / qn.norm / dn.norm), 6) as distance from qw join qn using (item_id) join dw using (term) join dn using (doc_id) group by all)
select item_id, doc_id, distance, rank from (select *, row_number() over (partition by item_id order by distance, doc_id) as rank from s) where rank <= 15""")
def tfidf_search_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, True).withColumn("rank", F.col("rank").cast("long"))


@query()
def near_dup_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text's candidates without near duplicates, the first five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = _lexical(spark, sf_dir, False).join(docs, "doc_id")
    return dedup.context(hits, search.WANTED, "item_id").select("item_id", "doc_id", "rank", "kept_rank")


@query("""with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as r from conversations where text <> '')
select conv_id as query_id, md5(string_agg('Fragment ' || r || ' [' || role || ']' || chr(10) || text || chr(10), chr(10) || '---' || chr(10) order by r)) as digest, count(*) as n_sources from t where r <= 5 group by conv_id""")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five turns of each conversation as a prompt's fragments."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").filter("text <> ''").withColumn("r", F.row_number().over(by)).filter(F.col("r") <= search.WANTED)
    none = F.lit(None).cast("string")
    ready = turns.select(F.col("conv_id").alias("query_id"), F.col("r").alias("kept_rank"), "text", F.col("role").alias("source"), none.alias("citation"), F.lit("").alias("source_display"), none.alias("source_kind"), F.lit("").alias("heading"))
    return answers.prompt_context(ready).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"), "n_sources")


@query("select doc_id, case when doc_id % 3 = 0 then lang || ' ' || source when doc_id % 3 = 1 then lang else source end as label, case lang when 'en' then 'закон РФ' else lang end as kind from documents")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first present of citation, display name and source; empty strings are missing."""
    third = lambda k, c: F.when(F.col("doc_id") % 3 == k, c).otherwise("")
    label = fn.source_label(third(0, F.concat_ws(" ", "lang", "source")), third(1, F.col("lang")), F.col("source"))
    kind = fn.kind_label(F.when(F.col("lang") == "en", "law").otherwise(F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"), kind.alias("kind"))


# The journal: events stand for interactions.


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("value").alias("response_time_ms"), F.col("event_type").alias("model"), F.lit("").alias("interface"),
        (F.col("event_type") == "view").alias("from_cache"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
    )


@query("""select count(*) as total, count(*) filter (event_type <> 'error') as success, count(*) filter (event_type = 'error') as failed, count(*) filter (event_type = 'view') as cache_hits,
round(count(*) filter (event_type = 'view') / count(*), 6) as hit_rate, round(avg(value), 2) as avg_ms, max(value) as max_ms from events""")
def journal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.stats(_journal(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 6))


@query("select event_type as model, count(*) as n from events group by 1 order by n desc, model nulls last limit 10")
def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.models(_journal(spark, sf_dir))


@query("""select event_id as id, ts as created_at, case when event_type = 'error' then 'error' else 'success' end as status, event_type = 'view' as from_cache, value as response_time_ms,
event_type as model, '—' as interface from events order by event_id desc limit 10""")
def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.recent(_journal(spark, sf_dir))


# The cache: users' turns ask.

_HASH = f"sha256('{NAMESPACE}||' || {_NORM.format('text')})"
_ANSWERED = f"(select {_HASH} as query_hash, conv_id, turn, text from conversations where role = 'user')"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.withColumn("query_hash", fn.cache_key(F.lit(NAMESPACE), F.col("text")))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that even conversations have filled and odd ones refresh: turns as times, conversations as answers."""
    rows = _asked(spark, sf_dir).select("query_hash", F.col("conv_id").cast("string").alias("answer"), F.col("turn").alias("created_at"), (F.col("conv_id") % 2 == 0).alias("old"))
    old, fresh = rows.filter("old").drop("old"), rows.filter("not old").drop("old")
    return answers.upsert(answers.upsert(old.limit(0), old), fresh)


@query(f"select conv_id, turn, query_hash from {_ANSWERED}")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", "query_hash")


_UPSERT = f"""select query_hash, answer, created_at from (select query_hash, conv_id::varchar as answer, turn as created_at,
row_number() over (partition by query_hash order by turn desc, conv_id % 2 desc, conv_id::varchar) as n from {_ANSWERED}) where n = 1"""


@query(_UPSERT)
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).select("query_hash", "answer", "created_at")


@query(f"with c as ({_UPSERT}), h as (select * from c where created_at > 0) select conv_id, turn, h.answer as answer, h.answer is not null as hit from {_ANSWERED} a left join h using (query_hash)")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only answers given after the first turn are stored."""
    cache = _stored(spark, sf_dir).filter("created_at > 0")
    found = answers.lookup(_asked(spark, sf_dir).drop("query_hash"), cache, NAMESPACE, "text")
    return found.select("conv_id", "turn", "answer", F.col("answer").isNotNull().alias("hit"))


@query(f"with c as ({_UPSERT}) select count(*) as total, min(created_at) as oldest, max(created_at) as newest from c")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.cache_stats(_stored(spark, sf_dir))


# Scores.


@query("select round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic, round((avg(quality) + avg(toxic)) / 2, 6) as overall from labels")
def eval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.means(table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("""with s as (select source, avg(quality) as score, count(*) as n from labels join documents using (doc_id) group by source)
select source, n, round(score, 6) as score, case when score >= 0.7 then 'good' when score >= 0.5 then 'fair' else 'poor' end as band from s""")
def score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    scored = table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("source").agg(F.avg("quality").alias("score"), F.count(F.lit(1)).alias("n"))
    return scored.select("source", "n", F.round("score", 6).alias("score"), evaluate.band(F.col("score")).alias("band"))


# Whole questions, pages, fingerprints.


@query()
def ask_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as questions; the stand-in for a model answers with a digest of the prompt."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    known = asked.filter("question_id % 5 = 0").select(fn.cache_key(F.lit(NAMESPACE), F.col("question")).alias("query_hash"), F.lit("known").alias("answer")).distinct()
    return answers.ask(spark, asked, table(spark, sf_dir, "documents"), known, NAMESPACE, MAX_DISTANCE, lambda p: F.md5(p.cast("binary")))


@query()
def sanitize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sanitize.sanitize_html(F.col("html")).alias("clean"))


_ROW = "sha256(coalesce(doc_id::varchar, chr(2)) || chr(1) || coalesce(text, chr(2)) || chr(1) || coalesce(source, chr(2)))"


@query(f"""with r as (select {_ROW} as h from documents), s as (select count(*) as n, {', '.join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::bigint)::varchar as p{i}" for i in range(4))} from r)
select n, sha256(n || '|' || p0 || '|' || p1 || '|' || p2 || '|' || p3) as fingerprint from s""")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table_fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


from . import corpora, details, statutes  # noqa: E402, F401 - they register their queries
