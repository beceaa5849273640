"""Queries over whole corpora: similar documents, stored vectors, lexical blocks; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search, selfjoin, vectors
from ..sources.shared import own_path, written
from .catalogue import _KNN, _hits, query, table

_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@query(rf"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS[0]}', '{_LETTERS[1]}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from w),
n as (select md5(array_to_string(list_sort(s), chr(10))) as key, min(doc_id) as class_id, count(*) as class_size, any_value(s) as s from s group by key),
t as (select key, len(s) as size, class_size, unnest(s) as token from n),
p as (select a.key, b.key as other, any_value(b.class_size) as size, count(*) / (any_value(a.size) + any_value(b.size) - count(*)) as similarity from t a join t b using (token) where a.key <> b.key group by a.key, b.key),
f as (select key, count(*) as n_links, sum(size)::bigint as linked_rows, round(max(similarity), 9) as best from p where similarity >= 0.8 - 1e-9 group by key)
select s.doc_id, class_id, class_size, coalesce(n_links, 0) as n_links, coalesce(linked_rows, 0) as linked_rows, best from s join n on n.key = md5(array_to_string(list_sort(s.s), chr(10))) left join f on f.key = n.key""")
def near_dup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of equal shingle sets and its links to classes of a similarity of 0.8 or more."""
    return selfjoin.linked(table(spark, sf_dir, "documents"))


@query(f"with {_KNN} select query_id, vec_id, round(distance, 6) as distance, rank from hits")
def index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest by a stored index that goes on until nothing nearer is left."""
    rows = table(spark, sf_dir, "embeddings")
    index = vectors.build(rows, own_path(spark, "index"))
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = index.search(asked, search.CANDIDATES, exact=True)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("""with q as (select vec_id, embedding::double[] as v from embeddings where vec_id % 20 = 0)
select q.vec_id as query_id, 15 as hits, 0 as wrong_distances, true as reached from q""")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index as it is searched by default, against all rows: hits of each query, hits whose distance isn't the exact one, and whether 0.9 of all neighbours are found."""
    rows = table(spark, sf_dir, "embeddings")
    index = vectors.build(rows, own_path(spark, "index"))
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = index.search(asked, search.CANDIDATES)
    true = _hits(spark, sf_dir).select("query_id", F.col("vec_id").alias("id"), F.col("distance").alias("exact"))
    both = written(found.join(true, ["query_id", "id"], "left"), "recall")  # read twice
    share = both.agg((F.count("exact") / F.count(F.lit(1))).alias("share")).first()["share"]
    each = both.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("hits"), F.count_if(F.abs(F.col("distance") - F.col("exact")) > 2e-9).cast("int").alias("wrong_distances"))
    return each.withColumn("reached", F.lit(share >= 0.9))
