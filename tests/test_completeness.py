"""Words of documents against words of their chunks; a task's share of structured texts."""

from lexmill.operators import chunking, structured


def test_word_balance(spark):
    docs = spark.createDataFrame([(1, "a b b\x1c c"), (2, None), (3, "x"), (4, "same"), (4, "id")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, "b a"), (1, "c\x1cd a"), (3, "x"), (4, "id same")], "doc_id long, body string")
    found = chunking.word_balance(docs, chunks)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {1: (4, 2, 2, 5), 2: (0, 0, 0, None), 3: (1, 0, 0, 1), 4: (2, 0, 0, 7)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan  # words aren't shuffled


def test_partitions_grow_with_texts(spark, monkeypatch):
    monkeypatch.setattr(structured, "PART_BYTES", 1000)
    docs = spark.range(100).selectExpr("id as doc_id", "repeat('1. Same. ', 100) as text", "'' as prefix")
    assert structured.lines_of(docs).rdd.getNumPartitions() == 90
    assert structured.lines_of(docs.limit(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
