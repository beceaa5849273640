"""Searches of the stored index hand on a bounded number of pairs."""

import numpy as np

from lexmill.operators import search, vectors


def test_tiles_hand_on_the_nearest_only(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1500, 16)))], "vec_id long, embedding array<double>")
    built = vectors.build(rows, str(tmp_path / "i"))
    counts, was = {}, vectors.written
    monkeypatch.setattr(vectors, "TILE", 400)
    monkeypatch.setattr(vectors, "written", lambda df, name: [t := was(df, name), counts.update({name: t.count()})][0])
    found = built.search(rows.filter("vec_id < 50").withColumnRenamed("vec_id", "query_id"), 10, exact=True)
    assert counts["near"] == 50 * 10 and found.count() == 50 * 10  # not the many that their codes chose


def test_several_tiles_of_queries(spark, tmp_path, monkeypatch):
    """Several tiles of queries and of rows give the results of one; rows meet the centres some at a time."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    want = sorted(search.knn(rows, rows["vec_id"] % 20 == 0, 5).collect())
    assert all(b.num_rows <= vectors.CODED for b in vectors._slices([rows.toArrow().combine_chunks().to_batches()[0]]))
    monkeypatch.setattr(search, "TILE", 20)
    monkeypatch.setattr(vectors, "TILE", 100)
    met = search.knn(rows, rows["vec_id"] % 20 == 0, 5)
    assert sorted(met.collect()) == want
    built = vectors.build(rows, str(tmp_path / "i"))
    found = built.search(rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5, exact=True)
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == sorted((r["query_id"], r["vec_id"]) for r in want)
