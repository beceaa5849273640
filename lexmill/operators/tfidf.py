"""A deterministic lexical embedding: hashed TF-IDF of stems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stems
from ..sources.shared import written

DIMENSIONS = 4096
#: Tiles of documents in a search.
TILES = 16


def terms(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, stem, tf). A text's stems are counted in its row: sorted, each run of equal ones is one entry, so that nothing is shuffled."""
    sorted_ = F.array_sort(stems(F.coalesce(F.col(text), F.lit(""))))
    last = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("stem"), i.alias("i"), F.coalesce(F.get(s, i + 1) == x, F.lit(False)).alias("goes_on"))), lambda x: ~x["goes_on"])
    counted = lambda e: F.transform(e, lambda x, i: F.struct(x["stem"].alias("stem"), (x["i"] - F.coalesce(F.get(e, i - 1)["i"], F.lit(-1))).cast("long").alias("tf")))
    return docs.select(id, F.inline(once(once(sorted_, last), counted)))


def once(value: Column, body) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def document_frequency(terms_of: DataFrame, total: int) -> DataFrame:
    """(stem, df, idf)"""
    idf = F.log((1 + F.lit(float(total))) / (1 + F.col("df"))) + 1
    return terms_of.groupBy("stem").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf)


def weights(terms_of: DataFrame, idf: DataFrame, total: int, id: str, bucketed: bool = False) -> DataFrame:
    """(id, term, w): unit vectors in sparse form; `bucketed` hashes stems to DIMENSIONS - 1 buckets. A stem the corpus lacks has the largest idf."""
    default = F.log(1 + F.lit(float(total))) + 1
    term = (F.crc32(F.col("stem").cast("binary")) % (DIMENSIONS - 1)).cast("int") if bucketed else F.col("stem")
    w = (1 + F.log("tf")) * F.coalesce(F.col("idf"), default)
    weighed = terms_of.join(idf, "stem", "left").select(id, term.alias("term"), w.alias("w"))
    if bucketed:
        weighed = weighed.groupBy(id, "term").agg(F.sum("w").alias("w"))
    listed = weighed.groupBy(id).agg(F.collect_list(F.struct("term", "w")).alias("all"))  # a document's distinct stems
    norm = F.sqrt(F.aggregate("all", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    return listed.withColumn("norm", norm).select(id, "norm", F.inline("all")).select(id, "term", (F.col("w") / F.col("norm")).alias("w"))


def vectors(weights_of: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """(id, vector): bucketed weights as dense vectors of DIMENSIONS; an id without a stem has the unit vector of the last place."""
    listed = weights_of.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("of"))
    slots = F.sequence(F.lit(0), F.lit(DIMENSIONS - 1))
    at = lambda i: F.when(F.col("of").isNull(), (i == DIMENSIONS - 1).cast("double")).otherwise(F.coalesce(F.try_element_at("of", i), F.lit(0.0)))
    return ids.select(id).join(listed, id, "left").select(id, F.transform(slots, at).alias("vector"))


def search(queries: DataFrame, docs: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """(query, doc, distance, rank) of the k documents of least cosine distance that share a term.

    A frequent term meets many documents: queries are sent to TILES tiles of documents, so that the term is no single key. A pair of a query and a
    document lies in one tile, and Spark keeps k of each query in every task before the last shuffle."""
    tile = F.pmod(F.xxhash64(doc), F.lit(TILES)).cast("int").alias("tile")
    sent = queries.withColumnRenamed("w", "qw").withColumn("tile", F.explode(F.array(*map(F.lit, range(TILES)))))
    met = docs.select("*", tile).join(sent, ["tile", "term"])
    scored = met.groupBy("tile", query, doc).agg(F.round(1 - F.sum(F.col("qw") * F.col("w")), 6).alias("distance")).drop("tile")
    by = Window.partitionBy(query).orderBy("distance", doc)
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


class Embedder:
    """The lexical embedding as vectors of DIMENSIONS, with the document frequencies of the texts it was made for."""

    def __init__(self, texts: DataFrame, id: str = "id", text: str = "text"):
        self.total = texts.count()
        self.idf = written(document_frequency(terms(texts, id, text), self.total), "idf")

    def __call__(self, texts: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
        """(id, embedding)"""
        found = weights(terms(texts, id, text), self.idf, self.total, id, True)
        return vectors(found, texts, id).withColumnRenamed("vector", "embedding")
