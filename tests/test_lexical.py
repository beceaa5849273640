"""Lexical search in blocks against scores of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import lexical, tfidf

RARE = [f"word{i:03}" for i in range(300)]


def corpus(rng, n):
    """Texts of words with a few frequent ones, as (id, text)."""
    some = ["alpha", "beta", "gamma", "delta"]
    texts = [" ".join(rng.choices(some, k=rng.randint(2, 12)) + [f"{a}{b}" for a, b in zip(rng.choices("abcdefgh", k=6), rng.choices(RARE, k=6), strict=True)]) for _ in range(n)]
    return list(enumerate(texts))


def plain(docs, queries, k, bucketed, spark):
    """By the shuffled search over all postings."""
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, question string")
    terms = tfidf.terms(d, "doc_id", "text")
    idf = tfidf.document_frequency(terms, len(docs))
    return tfidf.search(tfidf.weights(tfidf.terms(q, "query_id", "question"), idf, len(docs), "query_id", bucketed), tfidf.weights(terms, idf, len(docs), "doc_id", bucketed), "query_id", "doc_id", k)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["distance"]) for r in df.collect())


@pytest.mark.parametrize("bucketed", [False, True])
def test_same_rows_as_all_postings(spark, monkeypatch, bucketed):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    rng = random.Random(1)
    docs = corpus(rng, 200) + [(900, None), (901, ""), (902, "für и"), (903, "alpha " * 30_000)]
    docs += [(950 + i, docs[3][1]) for i in range(5)]  # ties
    queries = [(i, t) for i, (_, t) in enumerate(rng.sample(docs[:200], 20))] + [(70, "alpha"), (71, "unheard of"), (72, None), (73, docs[3][1])]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").withColumn("distance", F.lit("mine")), spark.createDataFrame(queries, "query_id long, question string")
    want = rows(plain(docs, queries, 7, bucketed, spark))
    assert rows(lexical.search(q, d.repartition(3), 7, bucketed=bucketed)) == want and len(want) > 100
    monkeypatch.setattr(lexical, "QUERY_TERMS", 40)
    assert rows(lexical.search(q, d.repartition(2), 7, bucketed=bucketed)) == want
    monkeypatch.setattr(lexical, "MOST_STEMS", 5)
    assert rows(lexical.search(q, d, 7, bucketed=bucketed)) == want


def test_empty(spark):
    d, q = spark.createDataFrame([(1, "alpha")], "doc_id long, text string"), spark.createDataFrame([(1, "alpha")], "query_id long, question string")
    assert lexical.search(q, d.limit(0), 3).count() == 0 and lexical.search(q.limit(0), d, 3).count() == 0


def test_frequent_stems_are_skipped():
    """Every document has ten frequent terms; queries with a rare one read a small part of the postings."""
    rng = np.random.default_rng(2)
    documents, n, rare = [], 6000, 3000
    for _ in range(n):
        terms = np.unique(np.concatenate([np.arange(10), rng.integers(10, 10 + rare, 8)]))
        w = np.where(terms < 10, 1.0, 7.0) * rng.uniform(0.8, 1.2, len(terms))
        documents.append((terms, w / np.linalg.norm(w)))
    queries = []
    for i in range(40):
        terms = np.sort(np.concatenate([np.arange(10), [10 + 7 * i, 13 + 7 * i]]))
        w = np.where(terms < 10, 1.0, 7.0)
        queries.append((terms, w / np.linalg.norm(w)))
    starts = np.cumsum([0] + [len(t) for t, _ in queries[:-1]])
    state = lexical.Search(lexical.Queries(list(range(40)), starts, np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])), 5)
    for at in range(0, n, 500):
        state.add(lexical.Block(documents[at : at + 500]), list(range(at, min(at + 500, n))))
    for (t, w), (scores, ids) in zip(queries, state.best, strict=True):
        exact = np.array([np.dot(w[np.isin(t, dt)], dw[np.isin(dt, t)]) for dt, dw in documents])
        want = np.argsort(-exact, kind="stable")[:5]
        found = np.array(ids)[np.argsort(-scores, kind="stable")][:5]
        assert np.allclose(exact[found], exact[want])
    assert state.held == 40 * 10 * n + sum(int((np.concatenate([d for d, _ in documents]) == t).sum()) for q, _ in queries for t in q if t >= 10)
    assert state.touched < 0.25 * state.held, (state.touched, state.held)


