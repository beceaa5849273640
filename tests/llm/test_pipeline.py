"""The stages and the whole pipeline against plain Python on small tables."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import langid, nearcopies, quality, simhash

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NEAR = dict(corpus_pipeline.STAGES)["near_dedup"]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def first_of_each(texts):
    """Positions that stay: the first of each component of texts with a similarity of 0.8."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in range(len(texts)) if find(i) == i}


def clean(t):
    """The text without its failing lines, or None where the document goes: the rules of quality.py, line by line."""
    r = quality.QualityRules()
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    repeated = {k for i, w in enumerate(windows) if seen[w] > 1 for k in (i, i + 1, i + 2)}
    if len(words) < r.min_words or 100 * len(repeated) > r.max_repeat_percent * len(words):
        return None

    def passes(line):
        s = line.strip(" \t\n\v\f\r")
        n = len(s.split())
        if not s:
            return True
        count = lambda chars: sum(c in chars for c in s)
        return (
            (re.search(quality.SENTENCE_END, s) is not None or n < r.min_words_unpunctuated)
            and count("#*$%&<>~^") <= n * r.max_symbols_per_word and len(s) - len(s.replace("!!", "!")) <= n * r.max_shouts_per_word
            and not (n >= 4 and count(quality.BARS) > n * r.max_bars_per_word)
            and not (n <= r.max_boilerplate_line_words and any(p in s.lower() for p in quality.BOILERPLATE))
        )

    kept = "\n".join(x for x in t.split("\n") if passes(x))
    size = lambda x: len(re.sub(r"[\x20\x09-\x0D]+", "", x))
    return kept if 1 - size(kept) / size(t) <= r.max_lost_share else None


def viterbi(model, words):
    """The labels of words, one step at a time."""
    scores = model.score(words)
    best, back = scores[0], []
    for row in scores[1:]:
        top = int(best.argmax())
        came = [k if best[k] >= best[top] - langid.SWITCH_PENALTY else top for k in range(len(row))]
        best = np.array([(best[k] if came[k] == k and best[k] >= best[top] - langid.SWITCH_PENALTY else best[top] - langid.SWITCH_PENALTY) for k in range(len(row))], dtype=np.float32) + row
        back.append(came)
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def speaks(model, text):
    """(language, share of words in its spans) of one text."""
    words = langid.words_of(text or "")
    if not words:
        return "und", 0.0
    counts = np.bincount(viterbi(model, words), minlength=len(model.languages))
    return model.languages[int(counts.argmax())], counts.max() / len(words)


def test_langid_against_a_plain_viterbi(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    model = langid.learn(docs)
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        lang, score = speaks(model, r["text"])
        assert found[r["doc_id"]]["lang_pred"] == lang and abs(found[r["doc_id"]]["score"] - score) < 1e-9


def test_langid_learns_every_label(spark):
    rng = random.Random(3)
    stems = {k: [f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}{b}" for a in ("ba", "co", "du") for b in ("x", "ym", "ze", "quu")] for k in range(300)}
    rows = [(k * 10 + i, " ".join(rng.choices(stems[k], k=40)), f"l{k:03}") for k in range(300) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.learn(docs)).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)
    assert langid.words_of("हिन्दी में") == ["हिन्दी", "में"]


def test_run(spark):
    """run() holds exactly the documents, texts and ids that a plain chain of the four stages leaves."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r.asDict() | {"text": t} for r in docs.collect() if (t := clean(r["text"])) is not None]
    rows.sort(key=lambda r: r["doc_id"])
    learned = spark.createDataFrame([r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1], docs.schema)
    model = langid.learn(learned)
    rows = [r for r in rows if (s := speaks(model, r["text"]))[0] != "und" and s[1] >= 0.5]
    stay = first_of_each([r["text"] for r in rows])
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {rows[i]["doc_id"]: t.encode(rows[i]["text"], add_special_tokens=False).ids + [0] for i in stay}
    found = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in found} == set(ids) and 0 < len(ids) < 200
    assert sum(r["length"] for r in found) == sum(map(len, ids.values()))
    for r in found:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    places = sorted((r["sequence_id"] * 1024 + r["offset"], r["length"]) for r in found)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({c: F.lit("mine") for c in ("kept", "score", "fp", "key", "_row", "bands", "spans")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, DATA)
        assert left.columns == docs.columns and left.filter("kept = 'mine' and score = 'mine' and key = 'mine' and bands = 'mine'").count() == left.count() > 0, name
        docs = left


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(None, "same words in this text here", "en", "a", 1), (None, "same words in this text here", "en", "a", 1), (4, "another one that stands alone there", "en", "a", 1), (4, "another one that stands alone there", "en", "a", 1), (2, "another one that stands alone there", "en", "a", 1), (None, None, None, None, None), (9, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(str(r["doc_id"]) for r in NEAR(spark, docs, DATA).collect()) == ["2", "9", "None"]


def test_near_copies_by_words(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(15):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 300))]
        for changes in (0, 1, 2, 3, 12):
            own = list(words)
            for k in rng.sample(range(len(own)), changes):
                own[k] = f"x{rng.randint(0, 5000)}"
            texts.append(" ".join(own))
    texts += [None, "", "one two", "One  two", "one three", "a much longer text " * 50_000]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert {r["doc_id"] for r in NEAR(spark, docs, DATA).collect()} == first_of_each(texts)
    prints = [simhash.fingerprint((t or "").encode()) & (2**64 - 1) for t in texts]
    stay = first_of_each(texts)
    assert any(i not in stay and all((p ^ q).bit_count() > 2 for q in prints[:i]) for i, p in enumerate(prints))


def test_large_groups_lose_no_link(spark):
    """Hundreds of texts that share most of their words: only those at 0.8 are joined, and the second round finds what the first can't see."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(160):
        own = list(base)
        for k in rng.sample(range(200), rng.choice((1, 2, 4, 5, 6, 8))):
            own[k] = f"x{rng.randint(0, 99999)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = first_of_each(texts)
    assert {r["doc_id"] for r in NEAR(spark, docs, DATA).collect()} == want and len(want) < 160
    met = spark.createDataFrame([(7, 0, False, (100, n, 0)) for n in range(40)], "token long, salt int, frequent boolean, at struct<size: int, node: long, pos: int>")
    roots = spark.createDataFrame([(n, 0) for n in range(1, 37)] + [(39, 38)], "node long, root long")
    pairs = {(r["a"], r["b"]) for r in nearcopies.across(met, roots).collect()}
    assert pairs == {(a, b) for b in (37, 38, 39) for a in range(37)} | {(37, 38), (37, 39)}
    few = met.filter("at.node < 3")
    assert nearcopies.across(few, roots.limit(0)).count() == 0 and nearcopies.across(few.withColumn("frequent", F.lit(True)), roots.limit(0)).count() == 3


@pytest.mark.parametrize("frequent", [1, 1000])
def test_any_order_of_tokens_loses_no_link(spark, monkeypatch, frequent):
    """Most tokens frequent, so that groups are split, or none."""
    monkeypatch.setattr("lexmill.operators.selfjoin.LEAST", frequent)
    monkeypatch.setattr(nearcopies, "NEAR", 2)
    monkeypatch.setattr(nearcopies, "in_sample", lambda key: F.lit(True))
    rng = random.Random(frequent)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        own = list(base)
        for k in rng.sample(range(120), rng.choice((0, 1, 2, 3, 4, 6))):
            own[k] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(own[rng.randint(0, 3) :]))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert {r["doc_id"] for r in NEAR(spark, docs, DATA).collect()} == first_of_each(texts)


def test_bins_never_exclude():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 900, rng.integers(1, 800))) for _ in range(2))
        x, y = (np.frombuffer(nearcopies.counted(s), dtype="<u2").astype(int) for s in (a, b))
        assert np.minimum(x, y).sum() >= len(np.intersect1d(a, b))


def test_written_tables_go(spark, tmp_path, monkeypatch):
    from lexmill.llm import common

    monkeypatch.setattr(common, "_written", [])
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert common.written(spark.range(3), "three").count() == 3 and len(list(tmp_path.iterdir())) == 1
    common.release(spark)
    assert not list(tmp_path.iterdir()) and not common._written
