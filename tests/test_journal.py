"""The journal, the cache, the manifest and the stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.operators import answers, evaluate, journal
from lexmill.sources import corpus
from lexmill.streaming import journal as stream


def rows(spark):
    at = dt.datetime(2024, 1, 1, 12)
    plain = lambda i, ms, model, cache, status="success": (i, at + dt.timedelta(minutes=i), f"q{i}", "r", cache, ms, model, 5, 3, status, None, "cli")
    return spark.createDataFrame([plain(1, 1200, "a", False), plain(2, 50, "a", True), plain(3, None, None, False, "error"), plain(4, 900, "b", False)], journal.SCHEMA)


def test_stats(spark):
    r = journal.stats(rows(spark)).first()
    assert (r["total"], r["success"], r["failed"], r["cache_hits"], r["hit_rate"], r["max_ms"]) == (4, 3, 1, 1, 0.25, 1200) and r["avg_ms"] == 716.67
    none = journal.stats(rows(spark).limit(0)).first()
    assert none["total"] == 0 and none["hit_rate"] == 0 and none["avg_ms"] is None
    assert [(x["model"], x["n"]) for x in journal.models(rows(spark)).collect()] == [("a", 2), ("b", 1), (None, 1)]
    assert [x["id"] for x in journal.recent(rows(spark), 2).collect()] == [4, 3] and journal.recent(rows(spark), 2).collect()[1]["model"] == "—"


def test_append_and_export(spark, tmp_path):
    path = str(tmp_path / "journal")
    fresh = rows(spark).withColumn("error_message", F.lit("token=abc12345"))
    journal.append(spark, fresh, path)
    journal.append(spark, fresh, path, store_text=True)
    back = spark.read.parquet(path).orderBy("id").collect()
    assert [r["id"] for r in back] == list(range(1, 9)) and back[0]["query"] == "" and back[7]["query"] == "q4" and back[0]["error_message"] == "token=[REDACTED]"
    journal.export_csv(spark.read.parquet(path), str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert lines[0] == ",".join(journal.SCHEMA.names) and len(lines) == 9


def test_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    rows(spark).write.parquet(path)
    q = stream.usage(stream.read(spark, path)).writeStream.format("memory").queryName("usage").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["model"], r["n"], r["failed"]) for r in spark.table("usage").collect()} == {("a", 2, 0), (None, 1, 1), ("b", 1, 0)}


def test_corpus(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_bytes("Первая\r\nстрока".encode()), b.write_bytes(b"second")
    entries = [{"path": str(p), "source": p.stem, "source_display": p.stem} for p in (a, b)]
    first = corpus.corpus_id(spark, entries)
    a.write_bytes("Первая\nстрока".encode())
    assert corpus.corpus_id(spark, entries) == first and len(first) == 12
    assert corpus.corpus_id(spark, entries[::-1]) != first and corpus.corpus_id(spark, entries, corpus.Settings(chunk_size=700)) != first
    assert corpus.manifest(spark, entries).first()["chunker"] == "generic"
    assert sorted(r["text"] for r in corpus.read_texts(spark, [str(a), str(b)]).collect()) == ["second", "Первая\nстрока"]
    with pytest.raises(Exception):
        corpus.read_texts(spark, [str(tmp_path / "none.txt")]).collect()
    b.write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):
        corpus.read_texts(spark, [str(b)]).collect()
    index = corpus.build_index(spark.range(3), str(tmp_path / "index"))
    assert index.count() == 3 and corpus.build_index(spark.range(9), str(tmp_path / "index")).count() == 3


def test_answers_and_scores(spark):
    text, keep = answers.complete(F.col("a"), F.col("f"))
    got = spark.createDataFrame([("x", "stop"), ("x", "length"), ("x", None)], "a string, f string").select(text.alias("t"), keep.alias("k")).collect()
    assert [(r["t"] == "x", r["k"]) for r in got] == [(True, True), (False, False), (True, True)]
    scores = spark.createDataFrame([(0.5, float("nan")), (1.0, None)], "a double, b double")
    assert tuple(evaluate.means(scores, ["a", "b"]).first()) == (0.75, 0.0, 0.75)
    assert [r[0] for r in spark.createDataFrame([(0.7,), (0.5,), (0.1,)], "s double").select(evaluate.band(F.col("s"))).collect()] == ["good", "fair", "poor"]


def test_contexts(spark):
    stored = ['["plain", {"text": "full", "id": "d1", "metadata": {"citation": "", "source_display": "Law", "section_heading": " Art. 1 "}}, {"other": 1}]', "[]", None, "not json"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(stored)], "i int, s string").select("i", answers.cached_context(F.col("s")).alias("c")).withColumn("shown", answers.sources(F.col("c"))).orderBy("i").collect()
    assert [tuple(x) for x in rows[0]["shown"]] == [("plain", "", ""), ("full", "Law", "Art. 1")] and [r["c"] for r in rows[1:]] == [None, None, None]
    results = spark.createDataFrame([("no_evidence", "n", "m", None), ("cached", "a", None, ["x"]), ("generated", "a", "m", ["x", "y"])], "outcome string, answer string, model string, sources array<string>")
    got = [(r["model"], r["from_cache"], r["sources_count"]) for r in answers.log_fields(results, "cfg", 5).collect()]
    assert got == [(None, False, 0), ("cfg", True, 1), ("m", False, 2)]
    assert [r[0] for r in spark.createDataFrame([("", "b"), (None, "")], "x string, y string").select(answers.document_text(F.col("x"), F.col("y"))).collect()] == ["b", ""]


def test_matches(spark):
    hits = spark.createDataFrame([(1, 1, "s", "1"), (1, 2, "s", "2"), (2, 1, "t", "9")], "query_id int, rank int, source string, article string")
    expected = spark.createDataFrame([(1, "s", "2"), (1, "z", None), (2, "s", None)], "query_id int, source string, article string")
    assert {tuple(r) for r in evaluate.first_match(hits, expected, ["source", "article"]).collect()} == {(1, 2), (2, None)}
    zipped = spark.range(1).select(evaluate.with_truth(F.array(F.lit("q")), F.array(F.lit("t"))).alias("z")).first()["z"]
    assert [tuple(x) for x in zipped] == [("q", "t")]
    with pytest.raises(Exception, match="reference answers"):
        spark.range(1).select(evaluate.with_truth(F.array(F.lit("q")), F.array(F.lit("t"), F.lit("u")))).collect()


def test_settings(monkeypatch):
    from lexmill import settings

    for value, want in (("", None), ("0.75", 0.75), ("2", 2.0)):
        monkeypatch.setenv("LEXMILL_MAX_DISTANCE", value)
        assert settings.max_distance() == want
    for value in ("abc", "0", "-0.5", "2.5", "nan", "inf", "0,5"):
        monkeypatch.setenv("LEXMILL_MAX_DISTANCE", value)
        with pytest.raises(ValueError, match="LEXMILL_MAX_DISTANCE"):
            settings.max_distance()
    monkeypatch.setenv("X", " Yes ")
    assert settings.flag("X") and not settings.flag("NONE") and settings.path("NONE", "d") == "d"


def test_remote(spark):
    from lexmill.sources import remote

    waits: list[float] = []
    left = [3]

    def flaky(x):
        left[0] -= 1
        if left[0] >= 0:
            raise TimeoutError
        return x

    assert remote.patient(flaky, wait=waits.append)("ok") == "ok" and waits == [1, 2, 4]
    left[0] = 99
    with pytest.raises(TimeoutError):
        remote.patient(flaky, 1, wait=waits.append)("ok")
    texts = spark.createDataFrame([(i, "x" * i) for i in range(40)], "id int, text string").coalesce(1)
    got = remote.embed(texts, lambda xs: [(i, [float(len(x)), float(len(xs))]) for i, x in reversed(list(enumerate(xs)))]).collect()
    assert all(r["embedding"][0] == r["id"] for r in got) and max(r["embedding"][1] for r in got) == 16
    said = remote.generate(texts.withColumnRenamed("text", "prompt"), lambda p: (p + "!", "stop")).first()
    assert (said["answer"], said["finish_reason"]) == ("!", "stop")
    with pytest.raises(Exception, match="blank answer"):
        remote.generate(texts.withColumnRenamed("text", "prompt"), lambda p: (" ", "stop")).collect()
    both = spark.createDataFrame([(True, 0.3), (True, 0.7), (False, 0.9)], "in_scope boolean, best_distance double")
    assert tuple(evaluate.margin(both).first()) == (0.7, 0.9)
