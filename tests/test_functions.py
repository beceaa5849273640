"""Scalar functions, sentences and pieces."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as fn
from lexmill.functions.pieces import fit, pack, sentences
from lexmill.operators import chunking, dedup, sanitize, search, tfidf


def one(spark, make, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(make(F.col("x"))).collect()]


def test_normalize_lines(spark):
    assert one(spark, fn.normalize_lines, "\r\n a\t b \r\n\r\n\n c  d\re\n\n", "", "\n\n") == [["a b", "", "c d", "e"], [], []]


def test_text_forms(spark):
    assert one(spark, fn.normalize_text, "\t A  B \n", "") == ["a b", ""]
    assert one(spark, lambda c: fn.truncate_words(c, 10), "one two three", "short") == ["one two…", "short"]
    assert one(spark, lambda c: fn.preview(c, 4), "abc def", "abc") == ["abc…", "abc"]
    assert one(spark, fn.is_all_caps, "ГОСТ 12", "Гост", "12") == [True, False, False]
    assert one(spark, fn.kind_label, "law", "other") == ["закон РФ", "other"]
    assert one(spark, lambda c: fn.source_label(c, F.lit(""), F.lit(None).cast("string")), "ст. 1", "", None) == ["ст. 1", "источник", "источник"]
    assert one(spark, fn.stems, "Ёлка и договора, 2024 abcdefg") == [["елка", "догов", "2024", "abcde"]]
    assert one(spark, lambda c: fn.cache_key(F.lit("n"), c), " What  IS it ")[0] == one(spark, lambda c: fn.cache_key(F.lit("n"), c), "what is it")[0]


def test_redact(spark):
    shown = ["key sk-abcDEF123 end", "Bearer abcdefgh12 x", "API_KEY = value1, next", "http://user:pw@host:80/x", "a plain task-list", None, "token: [REDACTED]"]
    want = ["key [REDACTED] end", "Bearer [REDACTED] x", "API_KEY = [REDACTED], next", "http://[REDACTED]@host:80/x", "a plain task-list", None, "token: [REDACTED]"]
    assert one(spark, fn.redact, *shown) == want
    assert one(spark, lambda c: fn.redact(c, "exactkey99"), "my exactkey99!") == ["my [REDACTED]!"]
    assert one(spark, fn.error_message, "x" * 1200)[0] == "x" * 1000 + "…"


def test_sentences():
    assert sentences("См. ст. 5 закона. Он действует! 14.1. Далее") == ["См. ст. 5 закона.", "Он действует!", "14.1.", "Далее"]
    assert sentences("14.1. Текст пункта. Второй.") == ["14.1. Текст пункта.", "Второй."]
    assert sentences("И. о. главы т.д. и пр. Нет") == ["И. о. главы т.д. и пр. Нет"]
    assert sentences('He said "Yes." Then left.') == ['He said "Yes."', "Then left."]


def test_pack_and_fit():
    assert pack(["aa", "bb", "cccc", "d"], 5, " ") == ["aa bb", "cccc", "d"]
    assert pack(["x" * 90, "y" * 5], 95, " ", 20, 120) == ["x" * 90 + " " + "y" * 5]
    assert [len(g) for g in pack(["z" * 30] * 10 + ["z" * 120], 100, " ")] == [92, 92, 92, 30, 120]
    words = [f"слово{i}" for i in range(300)]
    cut = fit(" ".join(words), 120)
    assert " ".join(cut).split() == words and max(map(len, cut)) <= 120
    assert fit("first part is here; second part is here; third", 30) == ["first part is here;", "second part is here; third"]


def test_generic_chunks(spark):
    docs = spark.createDataFrame([(1, "\n\n".join(" ".join(f"Слово{p}x{i}." for i in range(60)) for p in range(12))), (2, None), (3, "")], "doc_id long, text string")
    rows = chunking.generic(docs).orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {1} and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert max(len(r["body"]) for r in rows) <= 1200
    for a, b in zip(rows, rows[1:]):
        assert b["body"].split("\n\n")[0] == a["body"].split()[-1]


@pytest.mark.parametrize(
    "distances, metric, most, sufficient, best, reason",
    [
        ([0.9, 0.4], "cosine", 0.75, True, 0.4, "ok"), ([0.95, 0.7], "cosine", 0.75, True, 0.7, "ok"), ([0.9, 0.8], "cosine", 0.75, False, 0.8, "too_far"), ([0.75], "cosine", 0.75, True, 0.75, "ok"),
        ([1.0], "l2", 0.75, True, 0.5, "ok"), ([1.8], "l2", 0.75, False, 0.9, "too_far"), ([], "cosine", 0.75, False, None, "no_results"), ([], "cosine", None, False, None, "no_results"),
        ([5.0], None, 0.75, True, None, "unknown_metric"), ([None], "cosine", 0.75, True, None, "no_distance_info"), ([1.99], "cosine", None, True, 1.99, "threshold_disabled"),
    ],
)
def test_gate(spark, distances, metric, most, sufficient, best, reason):
    hits = spark.createDataFrame([(1, d) for d in distances], "query_id long, distance double")
    r = search.gate(spark.createDataFrame([(1,)], "query_id long"), hits, metric, most).first()
    assert (r["sufficient"], r["best_distance"], r["reason"]) == (sufficient, best, reason)


def test_context_dedup(spark):
    base = "the contract of guarantee names the amount, the term and the bank that pays it on demand"
    rows = [(1, 1, base), (1, 2, base + " "), (1, 3, base + "!"), (1, 4, "quite another fragment about something else, long enough to be compared"), (1, 5, ""), (1, 6, ""), (2, 1, "short"), (2, 2, "shorT")]
    hits = spark.createDataFrame(rows, "query_id long, rank int, text string")
    found = [(r["query_id"], r["rank"], r["kept_rank"]) for r in dedup.context(hits, 5).orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, 1), (1, 4, 2), (1, 5, 3), (1, 6, 4), (2, 1, 1)]
    assert dedup.context(hits, 2).count() == 3


def test_hashed_embedding(spark):
    docs = spark.createDataFrame([(1, "banana apple banana"), (2, "apple pear"), (3, "")], "id long, text string")
    terms = tfidf.terms(docs, "id", "text")
    idf = tfidf.document_frequency(terms, 3)
    rows = tfidf.weights(terms, idf, 3, "id", bucketed=True).collect()
    assert abs(sum(r["w"] ** 2 for r in rows if r["id"] == 1) - 1) < 1e-12 and all(0 <= r["term"] < 4095 for r in rows)


def test_sanitizer():
    assert sanitize.clean('<p onclick="x()">Hi <b>all</b><script>bad()</script><!-- c --></p>') == "<p>Hi all</p>"
    assert sanitize.clean('<a href="javascript:x">a</a><a href="//h">b</a><a href="https://h" title="t">c</a>') == '<a rel="noopener noreferrer">a</a><a rel="noopener noreferrer">b</a><a href="https://h" title="t" rel="noopener noreferrer">c</a>'
    assert sanitize.clean("<ul><li>x") == "<ul><li>x</li></ul>" and sanitize.clean(None) == "" and sanitize.clean("1 < 2 & 3") == "1 &lt; 2 &amp; 3"
