"""An index of sources that are rows of a table is brought up to date."""

from pyspark.sql import functions as F

from lexmill.operators import index

LAW = "Статья {}. Имя\n1. {}\n2. Вторая."


def test_only_changes_are_cut(spark, tmp_path):
    path = str(tmp_path / "index")

    def docs(rows):
        facts = {"source_display": "Закон", "source_kind": "law", "doc_type": "statute", "chunker": "federal_law", "citation": "Закон"}
        return spark.createDataFrame([(n, s, LAW.format(s, t)) for n, s, t in rows], "n long, source string, text string").withColumns({k: F.lit(v) for k, v in facts.items()})

    def update(rows):
        return sorted(r["source"] for r in index.update_sources(spark, docs(rows), path).collect())

    assert update([(0, "1", "а"), (1, "2", "б")]) == ["1", "2"]
    assert update([(0, "1", "а"), (1, "2", "б")]) == []
    assert update([(0, "3", "в"), (1, "2", "б"), (2, "1", "г")]) == ["1", "3"]  # one moves, one is new, one has changed
    rows = spark.read.parquet(f"{path}/chunks").orderBy(F.substring("id", 5, 9).cast("int")).collect()
    assert [(r["id"], r["source"], r["body"]) for r in rows[::2]] == [("doc_0", "3", "1. в"), ("doc_2", "2", "1. б"), ("doc_4", "1", "1. г")] and len(rows) == 6
    assert update([(0, "3", "в")]) == [] and spark.read.parquet(f"{path}/chunks").count() == 2  # sources that are gone
