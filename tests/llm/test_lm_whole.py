"""The language model learns from every training text."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from lexmill.llm import common, lm

PATH = P.path("byte_bpe_50k.tiktoken")


def test_every_training_text_is_learned(spark, monkeypatch):
    seen, was = {}, {name: getattr(lm, name) for name in ("company", "trained_further")}
    monkeypatch.setattr(lm, "company", lambda texts, *a: (seen.update(company=texts.count()), was["company"](texts, *a))[1])
    monkeypatch.setattr(lm, "trained_further", lambda model, texts, path: (seen.update(weights=texts.count()), was["trained_further"](model, texts, path))[1])
    lm.fit(spark.range(6000).selectExpr("id as doc_id", "concat('the word number ', id % 50) as text"), PATH)
    assert seen == {"company": 6000, "weights": 6000}


def test_the_last_windows_are_learned(spark):
    """A task with fewer windows than a batch learns from them too."""
    model = lm.Attention(lm.Vocabulary(PATH, np.arange(lm.IDS, dtype=float) % 89, np.ones((lm.IDS, 3))))
    before = {k: x.copy() for k, x in model.w.items()}
    lm.trained_further(model, spark.createDataFrame([("a few words",)], "text string"), PATH)
    assert all((before[k] != model.w[k]).any() for k in before)


def test_words_are_spelled_together():
    """New words take one call for a slice of texts; odd ones are spelled alone, and none differently."""
    of = lm.Speller(PATH)
    alone, spell = [], of.compute
    of.compute = lambda w: (alone.append(w), spell(w))[1]
    odd = ["²x", "Ⅷ", "a\u3000b", "\x85", "x\xa0", "\x1cy", "q" * 200]
    texts = ["The cat's paws, 3rd-best don't's ÉTÉ naïve 中文 １９ __a_b ''s 'tis \ufffd", *odd, "", " \n"]
    got = lm.spelled([x.encode() for x in texts], of)
    want = [np.frombuffer(b"".join(map(spell, [*x.encode().translate(lm.LOWER_BYTES).split(), b""])), dtype="<u2") for x in texts]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, want, strict=True))
    assert {w.decode() for w in alone} <= {"", *odd}


def test_words_are_spelled_once(spark, monkeypatch):
    """Company, first windows and training take the ids that one spelling has left, and these go before the joins."""
    texts = spark.range(90).selectExpr("id as doc_id", "concat('the word number ', id % 7, ' of it') as text")
    ids = lm.with_ids(texts, PATH)
    assert ids.columns == ["doc_id", "ids"] and lm.with_ids(ids, PATH) is ids
    anchors = np.array([262, 1573])
    assert np.allclose(lm.company(ids, PATH, anchors), lm.company(texts, PATH, anchors)) and lm.company(ids, PATH, anchors).any()
    assert all((a == b).all() for a, b in zip(lm.first_windows(ids, PATH), lm.first_windows(texts, PATH), strict=True))
    calls, was = [], lm.with_ids
    monkeypatch.setattr(lm, "with_ids", lambda t, path: (calls.append("text" in t.columns), was(t, path))[1])
    left = len(common._written)
    assert lm.score(texts, lm.F.col("doc_id") % 7 != 2, PATH).count() == 90
    assert calls.count(True) == 1 and not any("/ids-" in path for path, _ in common._written[left:])


def test_ids_become_words_again():
    of = lm.Speller(PATH)
    words = ["the", "cat's", "\u00e9t\u00e9", "\u4e2d\u6587", "q" * 200, "\x85", "a-b_c9"]
    codes = of.codes([w.encode() for w in words])
    sizes = np.array([len(c) // 2 for c in codes])
    assert lm.Words(PATH)(np.frombuffer(b"".join(codes), dtype="<u2"), sizes).to_pylist() == words
    assert lm.Words(PATH)(np.zeros(0, dtype="<u2"), np.zeros(0, dtype=int)).equals(pa.array([], pa.string()))


def test_known_words_arent_walked_through():
    """Learning a few words doesn't pass over all that are known."""

    class Known(lm.Speller):
        def __iter__(self):
            raise AssertionError("walks through all known words")

    of = Known(PATH)
    of.learn([b"first", b"words"])
    of.learn([b"more", b"words"])
    assert set(of.keys()) == {b"first", b"words", b"more"}


def test_windows_of_many_texts_are_each_texts():
    sizes = [1, 23, 24, 25, 1, 48, 100, 24]
    ids = np.random.default_rng(0).integers(0, 50000, sum(sizes))
    alone = [lm.windows(x) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    for got, want in zip(lm.windows(ids, sizes), map(np.concatenate, zip(*alone, strict=True)), strict=True):
        assert (got == want).all()
