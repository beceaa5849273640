"""The stored vector index against all rows; questions over the index of a corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import answers, index, tfidf, vectors
from test_index import entries

SCHEMA = "vec_id long, embedding array<float>, v string, list string, row string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "mine", "mine", "mine", "mine") for i, v in rows], SCHEMA).repartition(3)


def nearest(rows, queries, k):
    """{query: [(distance, id)]} by comparing all."""
    good = [(i, np.array([np.float32(x) for x in v], dtype=np.float64)) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([v / np.linalg.norm(v) for _, v in good])
    out = {}
    for q, v in queries:
        v = np.array([np.float32(x) for x in v], dtype=np.float64)
        d = np.round(1 - m @ (v / np.linalg.norm(v)), 9) + 0.0
        out[q] = sorted((d[j], good[j][0]) for j in range(len(good)))[:k]
    return out


def found_by(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    some = [(i, centres[i % 12] + 0.3 * rng.normal(size=16)) for i in range(500)] + [(500 + i, rng.normal(size=16)) for i in range(500)]
    some += [(2000 + i, some[0][1]) for i in range(300)]  # copies of one vector
    some += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None, *[1.0] * 15]), (3005, [1.0] * 15), (3006, [float("inf")] * 16), (7, rng.normal(size=16)), (7, some[7][1])]
    return some


@pytest.mark.parametrize("tile", [50, 8192])
def test_search(spark, rows, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    built = vectors.build(frame(spark, rows), str(tmp_path / "i"))
    assert built.info["rows"] == 1302 and (built.info["parts"] > built.info["lists"]) == (tile == 50)
    opened = vectors.VectorIndex(spark, str(tmp_path / "i"))
    asked = [(i, v) for i, v in rows[:1000:9]] + [(9000, rows[0][1])]
    queries = frame(spark, asked + [(9001, None), (9002, [1.0])]).withColumnRenamed("vec_id", "query_id")
    want = nearest(rows, asked, 20)
    exact = found_by(opened.search(queries, 20, exact=True))
    assert exact.keys() == want.keys()
    assert all(abs(a - c) < 3e-9 and b == d for q in want for (a, b), (c, d) in zip(exact[q], want[q], strict=True) if len({round(x, 8) for x, _ in want[q]}) == 20)
    assert all(np.allclose([d for d, _ in exact[q]], [d for d, _ in want[q]], atol=3e-9) for q in want)
    quick = found_by(opened.search(queries, 20))
    hits = [sum(d <= want[q][-1][0] + 3e-9 for d, _ in quick[q]) for q in want]
    assert sum(hits) >= 0.9 * 20 * len(want) and all(len(x) == 20 for x in quick.values())
    few = found_by(opened.search(queries, 20, probes=1, candidates=1, exact=True))  # a poor start makes more work and the same result
    assert all(np.allclose([d for d, _ in few[q]], [d for d, _ in want[q]], atol=3e-9) for q in want)
    others = found_by(opened.search(queries, 3, without=F.col("id") == F.col("query_id"), exact=True))
    assert all(i != q for q, hits in others.items() for _, i in hits)


def test_recall_without_clusters(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16)) for i in range(4000)]
    built = vectors.build(frame(spark, rows), str(tmp_path / "i"))
    asked = rows[::40]
    want = nearest(rows, asked, 20)
    quick = found_by(built.search(frame(spark, asked).withColumnRenamed("vec_id", "query_id"), 20))
    assert sum(len(set(quick[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)
    assert built.info["probes"] < built.info["lists"]


def test_empty_and_small(spark, tmp_path):
    one = frame(spark, [(1, [1.0, 2.0])])
    queries = one.withColumnRenamed("vec_id", "query_id")
    assert vectors.build(one.limit(0), str(tmp_path / "none")).search(queries, 3).count() == 0
    built = vectors.build(one, str(tmp_path / "one"))
    assert found_by(built.search(queries, 3)) == {1: [(0.0, 1)]} and built.search(queries.limit(0), 3, exact=True).count() == 0


def test_corpus_has_vectors(spark, tmp_path):
    listed, path = entries(tmp_path), str(tmp_path / "index")
    made = {}

    def embed(rows, id="id", text="text"):
        made["e"] = made.get("e") or tfidf.Embedder(rows, id, text)
        return made["e"](rows, id, text)

    index.load_corpus(spark, listed, path, str(tmp_path), embed=embed)
    asked = spark.createDataFrame([(1, "Заметка о гарантиях"), (2, "Тезис два"), (3, "xyz")], "question_id long, question string")
    near = index.nearest(spark, path, embed(asked, "question_id", "question").withColumnRenamed("question_id", "query_id"), 2, exact=True).filter("rank = 1")
    assert {r["query_id"]: r["anchor"] for r in near.collect() if r["query_id"] < 3} == {1: "chunk.0", 2: "pos.2"}
    cache = spark.createDataFrame([], answers.CACHE)
    told = answers.ask_index(spark, asked, path, cache, "ns", 0.9, lambda p: p, embed, exact=True).collect()
    by = {r["question_id"]: r for r in told}
    assert by[3]["outcome"] == "no_evidence" and by[1]["outcome"] == "generated"
    assert "Fragment 1 [Ц2, kind: law]" in by[1]["answer"] and "Heading: " in by[2]["answer"] and "Тезис два." in by[2]["answer"]
