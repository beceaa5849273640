"""The index of a corpus: dispatch, ids, errors, the stored index; the stored cache."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.operators import answers, index, tfidf

LAW = "Статья 1. Общее\n1. Первая часть.\n2. Вторая часть.\nСтатья 2. Прочее\n1. Ещё часть."
REVIEW = "Обзор практики\nПозиция 1\nТезис один.\nПозиция 2\nТезис два."


def entries(tmp_path):
    found = []
    for n, (name, text, chunker) in enumerate((("law", LAW, "federal_law"), ("review", REVIEW, "court_review"), ("notes", "Заметка о гарантиях.", "generic"))):
        (tmp_path / f"{name}.txt").write_text(text)
        found.append({"path": f"{name}.txt", "source": name, "source_display": f"Источник {n}", "source_kind": "law", "doc_type": "statute", "chunker": chunker, "citation": f"Ц{n}"})
    return found


def test_load_corpus(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = index.load_corpus(spark, entries(tmp_path), path, str(tmp_path)).collect()
    rows.sort(key=lambda r: int(r["id"].removeprefix("doc_")))
    assert [(r["id"], r["source"], r["anchor"]) for r in rows] == [
        ("doc_0", "law", "art.1/part.1"), ("doc_1", "law", "art.1/part.2"), ("doc_2", "law", "art.2/part.1"), ("doc_3", "review", "preamble"), ("doc_4", "review", "pos.1"), ("doc_5", "review", "pos.2"), ("doc_6", "notes", "chunk.0"),
    ]
    assert rows[0]["text"].startswith("[Источник: Источник 0 | закон РФ]\n[Фрагмент: Статья 1. Общее — ч. 1]") and rows[4]["position"] == 1 and rows[6]["citation"] == "Ц2"
    info = index.stats(spark, path).first()
    assert (info["count"], info["metric"], info["chunk_size"]) == (7, "cosine", 800)
    assert index.metric(index.stats(spark, path)).first()["metric"] == "cosine"
    (tmp_path / "law.txt").write_text("changed")
    assert index.load_corpus(spark, entries(tmp_path)[:1], path, str(tmp_path)).count() == 7  # it is there, so nothing is read
    assert [r.asDict() for r in index.anchors(spark.read.parquet(f"{path}/chunks").filter("source = 'law'")).collect()] == [{"source": "law", "articles": 2, "parts": 2, "points": 0, "positions": 0, "anchors": 3}]
    one = index.load_documents(spark, str(tmp_path / "notes.txt"), str(tmp_path / "one")).collect()
    assert [(r["id"], r["source"]) for r in one] == [("doc_0", "single_file")]


@pytest.mark.parametrize("chunker, text", [("federal_law", "Просто текст."), ("civil_code", ""), ("government_resolution", "Текст без пунктов."), ("court_review", "Позиция 1\nПозиция 2\nТезис.")])
def test_structure_errors(spark, tmp_path, chunker, text):
    (tmp_path / "x.txt").write_text(text)
    entry = {"path": "x.txt", "source": "x", "source_display": "X", "chunker": chunker}
    with pytest.raises(index.StructureError, match="no units"):
        index.load_corpus(spark, [entry], str(tmp_path / "index"), str(tmp_path))
    assert not (tmp_path / "index").exists()


def test_other_errors(spark, tmp_path):
    (tmp_path / "x.txt").write_text(LAW)
    (tmp_path / "e.txt").write_text("")
    entry = {"path": "x.txt", "source": "x", "source_display": "X", "chunker": "federal_law"}
    with pytest.raises(index.StructureError, match="told apart"):
        index.load_corpus(spark, [entry, entry], str(tmp_path / "index"), str(tmp_path))
    with pytest.raises(index.StructureError, match="unknown chunker"):
        index.load_corpus(spark, [entry | {"chunker": "nope"}], str(tmp_path / "index"), str(tmp_path))
    with pytest.raises(index.StructureError, match="no chunk"):
        index.load_corpus(spark, [entry | {"path": "e.txt", "chunker": "generic"}], str(tmp_path / "index"), str(tmp_path))
    assert index.metric(spark.createDataFrame([("x", "dot")], "name string, metric string")).first()["metric"] is None


def test_stored_cache(spark, tmp_path, monkeypatch):
    cache = answers.Cache(spark, str(tmp_path / "cache"))
    assert cache.rows().count() == 0 and cache.stats().first()["total"] == 0
    row = lambda key, answer, hour: (key, "q", answer, None, dt.datetime(2024, 1, 1, hour))
    made = lambda *rows: spark.createDataFrame(rows, answers.CACHE)
    cache.upsert(made(row("a", "old", 1), row("b", "kept", 2)))
    cache.upsert(made(row("a", "new", 3)))
    assert {(r["query_hash"], r["answer"]) for r in cache.rows().collect()} == {("a", "new"), ("b", "kept")}
    stats = cache.stats().first()
    assert (stats["total"], stats["oldest"], stats["newest"], stats["enabled"]) == (2, "2024-01-01T02:00:00", "2024-01-01T03:00:00", True)
    off = answers.Cache(spark, str(tmp_path / "cache"), enabled=False)
    off.upsert(made(row("c", "x", 4)))
    assert off.stats().first().asDict() == {"total": 0, "oldest": None, "newest": None, "enabled": False, "size_mb": 0.0}
    off.clear()
    assert cache.rows().count() == 2
    other = answers.Cache(spark, str(tmp_path / "cache"))  # two writers that have read the same state lose nothing
    first, second = cache.rows(), other.rows()
    cache.upsert(first.limit(0).union(made(row("d", "one", 5), row("f", "early", 5))))
    other.upsert(second.limit(0).union(made(row("e", "two", 5), row("f", "late", 5))))
    want = {("a", "new"), ("b", "kept"), ("d", "one"), ("e", "two"), ("f", "late")}
    assert {(r["query_hash"], r["answer"]) for r in cache.rows().collect()} == want and len(cache._parts()) == 4
    cache.merge()
    assert {(r["query_hash"], r["answer"]) for r in other.rows().collect()} == want and len(cache._parts()) == 1
    monkeypatch.setattr(answers, "PARTS", 2)
    for hour in (6, 7, 8):
        cache.upsert(made(row("a", f"at {hour}", hour)))
    assert len(cache._parts()) <= 2 and cache.rows().filter("query_hash = 'a'").first()["answer"] == "at 8" and cache.rows().count() == 5
    (tmp_path / "cache" / "99999999999999999999-broken").mkdir()  # a write that failed
    assert cache.rows().count() == 5
    cache.clear()
    assert cache.rows().count() == 0 and cache.stats().first()["size_mb"] == 0


def test_contexts_go_and_come_back(spark):
    rows = spark.createDataFrame([(1,)], "i int").select(F.from_json(F.lit('[{"text": "a", "metadata": {"citation": "c"}}]'), answers.CONTEXT).alias("x"), F.from_json(F.lit("[]"), answers.CONTEXT).alias("none"))
    r = rows.select(answers.cached_context(answers.stored_context(F.col("x"))).alias("back"), answers.stored_context(F.col("none")).alias("none")).first()
    assert r["back"][0]["text"] == "a" and r["back"][0]["metadata"]["citation"] == "c" and r["none"] is None


def test_dense_vectors(spark):
    docs = spark.createDataFrame([(1, "banana apple banana"), (3, "")], "id long, text string")
    terms = tfidf.terms(docs, "id", "text")
    found = {r["id"]: r["vector"] for r in tfidf.vectors(tfidf.weights(terms, tfidf.document_frequency(terms, 2), 2, "id", True), docs, "id").collect()}
    assert abs(sum(x * x for x in found[1]) - 1) < 1e-12 and found[3] == [0.0] * 4095 + [1.0]


def test_update_cuts_only_what_changed(spark, tmp_path, monkeypatch):
    """The same chunks and ids as a full build, whatever changes; sources that stay aren't read by a chunker."""
    listed, path = entries(tmp_path), str(tmp_path / "index")
    index.load_corpus(spark, listed, path, str(tmp_path))
    cut = []
    plain_cut = index.chunk_corpus
    monkeypatch.setattr(index, "chunk_corpus", lambda docs, *rest: cut.append(sorted(r[0] for r in docs.select("source").collect())) or plain_cut(docs, *rest))

    def same(expected):
        cut.clear()
        assert index.update_corpus(spark, listed, path, str(tmp_path)) == expected
        assert [x for c in cut for x in c] == sorted(expected)
        full = index.load_corpus(spark, listed, str(tmp_path / f"full{len(list(tmp_path.iterdir()))}"), str(tmp_path)).drop("pos")
        now = spark.read.parquet(f"{path}/chunks").select(full.columns)
        assert sorted(map(str, now.collect())) == sorted(map(str, full.collect()))
        assert index.stats(spark, path).first()["count"] == now.count()

    same([])
    (tmp_path / "law.txt").write_text(LAW + "\n2. Новая часть.")
    same(["law"])
    listed[2]["citation"] = "другая"
    same(["notes"])
    listed.reverse()
    same([])
    (tmp_path / "more.txt").write_text("Ещё одна заметка.")
    listed.insert(1, {"path": "more.txt", "source": "more", "source_display": "M", "chunker": "generic"})
    same(["more"])
    del listed[0]
    same([])
    (tmp_path / "law.txt").write_text("Просто текст.")
    with pytest.raises(index.StructureError, match="no units"):
        index.update_corpus(spark, listed, path, str(tmp_path))
    (tmp_path / "law.txt").write_text(LAW + "\n2. Новая часть.")
    same([])
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("index.")]
