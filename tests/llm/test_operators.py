"""The operators against plain ones on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import ann, bpe, langid, license, lm, packing, quality, sharding, simhash, tokencount
from lexmill.llm.tokens import merge, pieces, read_ranks

WORDS = "the and of tion sehr schön le père 's don't x² Ⅷ １２ 中文 a-b | ### !! . \n \t 　".split(" ")


def texts() -> list:
    rng = random.Random(3)
    some = [" ".join(rng.choices(WORDS, k=rng.randint(1, 90))) for _ in range(24)]
    line = "One line that is said again and again here."
    return [None, "", " \n\t ", "a", "x" * 500, "'re 'r'v'll  'll\n's", "<|endoftext|>a <|endoftext|>", *some, some[0], some[0], some[1] + " end", "\n".join([line] * 30), "The words of a plain page stand here. " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, ("en", "de", None)[i % 3], ("a", "a", None, "b")[i % 4], len(t or "")) for i, t in enumerate(texts())]
    rows.append(rows[8])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).withColumn("kept", F.lit("mine")).withColumn("score", F.lit("mine")).withColumn("fp", F.lit("mine")).repartition(3)


@pytest.fixture
def at(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture
def empty(docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_bpe(spark, docs, at):
    import tiktoken

    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), len(ids := e.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows_of(docs))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.op1_bpe(spark, at).collect()) == want
    distinct = sorted({p for _, t in rows_of(docs) for p in pieces(t)} - {"x" * 500})
    found = bpe.encode_words(spark.createDataFrame([(w,) for w in distinct], "word string"), ranks).collect()
    assert all(r["ids"] == merge(r["word"].encode(), ranks) for r in found)


def test_merge_long_words():
    ranks = read_ranks(P.path("byte_bpe_50k.tiktoken"))
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for n in (49, 80, 300):
        word = "".join(rng.choices("theandoftion", k=n))
        assert merge(word.encode(), ranks) == e.encode_ordinary(word)


def test_token_counts(spark, docs, at):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((str(i), len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for i, x in rows_of(docs))
    assert sorted((str(r[0]), *r[1:]) for r in tokencount.op10_tokencount(spark, at).collect()) == want


def test_packing(spark, docs, at):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {}
    for i, x in rows_of(docs):
        ids.setdefault(i, []).append(t.encode(x, add_special_tokens=False).ids + [0])
    found = [r.asDict() for r in packing.op6_packing(spark, at).collect()]
    for i, each in ids.items():
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in found if r["doc_id"] == i)
        assert sum(n for _, n, _ in own) == sum(map(len, each))
        for s, n, crc in own:
            assert crc == zlib.crc32(np.array(each[0][s : s + n], dtype="<u4").tobytes())
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for s in sorted(by):
        at_ = 0
        for offset, n in sorted(by[s]):
            assert offset == at_
            at_ += n
        sizes.append(at_)
    assert sorted(by) == list(range(len(by))) and set(sizes[:-1]) <= {1024} and sizes[-1] <= 1024


def stream(spark, rows, **more):
    """(pieces in their order, sources of all tokens in their order)"""
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    found = packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), **more).orderBy("sequence_id", "offset").collect()
    return found, [rows[r["doc_id"]][1] for r in found for _ in range(r["length"])]


def test_targets_hold_in_every_window(spark):
    rng = random.Random(7)
    rows = [(" ".join(rng.choices(WORDS, k=rng.randint(1, 400))), s) for s, n in (("a", 60), ("b", 40), ("c", 30), (None, 5)) for _ in range(n)]
    targets = {"a": 0.7, "b": 0.2, "c": 0.1}
    found, sources = stream(spark, rows, targets=targets, sequence=64, window=8)
    totals = Counter(sources)
    size, at = 64 * 8, 0
    while True:
        at += size
        had = Counter(sources[:at])
        if any(had[s] > totals[s] - size for s in targets):
            break
        # windows may be a token off at their ends, each source within one of its quanta
        assert all(abs(had[s] - p * at) <= 2 for s, p in targets.items()) and not had[None]
    assert at > 5 * size and sources[-1] is None and totals == Counter(sources)
    with pytest.raises(ValueError, match="shares"):
        stream(spark, rows, targets={"a": 0.9, "b": 0.2})


def test_many_sources_each_have_a_queue(spark):
    rng = random.Random(8)
    rows = [(" ".join(rng.choices(WORDS, k=rng.randint(1, 60))), f"s{i % 1500}") for i in range(3000)]
    found, sources = stream(spark, rows, sequence=16, window=4)
    totals, n = Counter(sources), len(sources)
    size = 16 * 1500
    had = Counter(sources[:size])
    assert all(abs(had[s] - totals[s] * size / n) <= 2 for s in totals) and len(totals) == 1500
    by_doc = Counter()
    for r in found:
        by_doc[r["doc_id"]] += r["length"]
    assert all(by_doc[r["doc_id"]] == r["doc_tokens"] for r in found)


def test_schedule():
    times, rows = packing.schedule({"a": 100, "b": 10, "rest": 30}, {"a": 0.5, "b": 0.5, "rest": 0.0})
    assert times == [0.0, 20.0, 110.0] and rows["a"] == ([0.0, 10.0, 100.0], [0.5, 1.0, 0.0]) and rows["rest"] == ([0.0, 0.0, 0.0], [0.0, 0.0, 1.0])


def test_quality(spark, docs, at):
    def base(t):
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = Counter(windows)
        repeat = {k for i, x in enumerate(windows) if many[x] > 1 for k in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)

    found = quality.op3_quality(spark, at).collect()
    assert sorted((str(r[0]), *r[1:7]) for r in found) == sorted((str(i), *base(t)) for i, t in rows_of(docs))
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_quality_lines(spark):
    rng = random.Random(9)
    clean = "\n".join(" ".join(f"word{rng.randint(0, 999)}" for _ in range(11)) + "." for _ in range(12))
    nav = " | ".join(f"Item{n}" for n in range(80))
    shout = "\n".join(" ".join(f"WORD{k}{n}!!" for n in range(10)) for k in range(8))
    marked = " ".join(f"word{n}$$$" for n in range(90))
    mixed = clean + "\nHome | News | Sport | About | Contact\nClick here to accept cookies."
    rows = spark.createDataFrame(list(enumerate([clean, nav, shout, marked, mixed])), "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality.quality(rows).collect()}
    assert [found[i]["kept"] for i in range(5)] == [True, False, False, False, True]
    assert found[4]["cleaned_text"] == clean


def test_license(spark, docs, at, tmp_path):
    extra = ["CC-BY cc by, MIT License! gnu General\nPublic license", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception"]
    many = docs.unionByName(spark.createDataFrame([(900 + i, t, "en", "a", 1, "m", "m", "m") for i, t in enumerate(extra)], docs.schema))
    many.write.parquet(f"{tmp_path}/more/documents.parquet")

    def base(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        hits = [(i, label) for p, label in license.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at_ = [i for i, _ in hits]
        return len(w), len(hits), min(at_, default=None), max(at_, default=None), ",".join(sorted({x for _, x in hits}))

    found = license.op5_license(spark, f"{tmp_path}/more").collect()
    assert sorted(map(str, ((r[0], *r[1:6]) for r in found))) == sorted(map(str, ((i, *base(t)) for i, t in rows_of(many))))
    assert next(r for r in found if r["doc_id"] == 901)["labels"] == "apache,gpl,mit"
    assert license.postfix("a or b and c with d".split()) == "a b c d with and or".split()
    assert license.postfix("( a or b".split()) is None and license.postfix("a b".split()) is None
    assert license.evaluate("mit or gpl-3.0")[1] and not license.evaluate("mit and gpl-3.0")[1]


def test_simhash(spark, docs, at):
    def fp(t):
        w = lower(t).encode().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, fp(t)) for i, t in rows_of(docs)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    want = sorted(map(str, ((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(rows))))
    assert sorted(str((r[0], r[1], r[2])) for r in simhash.op8_simhash(spark, at).collect()) == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [tuple(sorted(rng.sample(range(100, 400), 2))) for _ in range(150)] + [(500, i) for i in range(501, 540)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in found} == {(x, find(x)) for x in root if find(x) != x}


def test_sharding(spark, docs, at):
    found = sharding.op9_sharding(spark, at).collect()
    texts_ = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows_of(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == texts_
    for s in range(8):
        own = sorted(r["slot"] for r in found if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in found)
    many = sharding.assign(sharding.assign(spark.range(20000), "id", 8), "id", 9, "more").collect()
    sizes = Counter(r["shard"] for r in many)
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.1 * 2500
    assert {r["more"] for r in many if r["more"] != r["shard"]} == {8}


def test_langid(spark, docs, at):
    train = ["the quick dog and the house of that man with it", "der schnelle hund und das haus mit dem mann ist", "Это быстрая собака и дом человека"]
    rows = [(i, train[i % 3], ("en", "de", "ru")[i % 3]) for i in range(30)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ask = ["the house with that dog", "das haus mit dem hund", "собака и дом", "the dog of that man and the house it is with that der mann ist mit dem hund und das haus ist schnelle", "12 . --", None, ""]
    found = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string"), model).collect()}
    assert [found[i]["lang_pred"] for i in range(7)] == ["en", "de", "ru", "en", "und", "und", "und"]
    assert [s["lang"] for s in found[3]["spans"]] == ["en", "de"]
    assert found[6]["score"] == 0 and all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.op4_langid(spark, at).count() == docs.count()
    none = langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.identify(spark.createDataFrame([(1, "word")], "doc_id long, text string"), none).first()["lang_pred"] == "und"


def test_lm(spark, docs, at):
    rows = rows_of(docs)
    tokens = {k: [*lower(t).encode().split(), b""] for k, (_, t) in enumerate(rows)}
    out = {k: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for k, (i, _) in enumerate(rows)}
    c = Counter(w for k, ws in tokens.items() if not out[k] for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(rows[k][0]), out[k], len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for k, ws in tokens.items())
    found = lm.op2_lm(spark, at).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in found) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_lm_score_is_the_models(spark, docs, at):
    """The score, text by text and word by word from the fitted weights."""
    path = P.path("byte_bpe_50k.tiktoken")
    rows = rows_of(docs)
    out = {("" if i is None else str(i)): zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    model = lm.fit(docs.filter(~lm.held_out(F.col("doc_id"), 7, 2)), path)
    c, v, spell = {r["word"].encode(): r["c"] for r in model.counts.collect()}, model.attention.v, lm.speller(path)
    assert model.hot == {w: n for w, n in c.items()} and model.n == sum(c.values())

    def cut(t):
        """(words, log-probability) of each passage of a text, and its key."""
        words = [*lower(t).encode().split(), b""]
        ids = [np.frombuffer(spell[w], dtype="<u2") for w in words]
        inputs, targets = lm.windows(np.concatenate(ids))
        logits = model.attention.forward(inputs)[-1].astype(float).reshape(-1, v.size)[: sum(map(len, ids))]
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        begin, at_ = p[:, : v.beginning].sum(axis=1), 0
        logs = []
        for w, x in zip(words, ids):
            n = len(x)
            own = np.prod([p[at_ + k, v.classes[i]] * np.exp(v.within[i]) for k, i in enumerate(x)])
            after = begin[at_ + n] if w else 1.0
            group = p[at_, v.classes[x[0]]] / begin[at_]
            logs.append(math.log((1 - model.spelling) * group * c.get(w, 0) / max(1, v.words[v.classes[x[0]]]) + model.spelling * own / begin[at_] * after))
            at_ += n
        h = lm.word_hashes(np.concatenate(ids), np.cumsum([0, *map(len, ids)])[:-1])
        starts, marks = lm.passages(h, np.arange(len(words)) == len(words) - 1)
        return [(m, sum(logs[a:z])) for m, a, z in zip(marks.tolist(), starts, [*starts[1:], len(words)])]

    texts_ = [(str(i if i is not None else ""), cut(t)) for i, t in rows]
    seen = Counter(m for i, ps in texts_ if not out[i] for m, _ in ps)
    again, all_ = sum(n - 1 for n in seen.values()), sum(seen.values())
    assert again
    want = sorted((i, sum(math.log((1 - again / all_) * math.exp(x) + (seen[m] - 1) * (seen[m] > 1) / all_) if x > -700 or seen[m] > 1 else x + math.log(1 - again / all_) for m, x in ps) / math.log(10)) for i, ps in texts_)
    got = sorted(("" if r["doc_id"] is None else str(r["doc_id"]), r["score"]) for r in lm.op2_lm(spark, at).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=5e-3, atol=0.02)


def test_id_counts_are_those_of_words(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    some = [(w, i + 1) for i, w in enumerate(["the", "don't", "x²", "中文", "a-b", "a\u00a0", "\u3000b", "12ab", "ß", ""])] + [(f"w{i}", 2) for i in range(300)]
    spell = lm.speller(path)
    for rows in (some, [r for r in some if r[0] and not lm._OTHER_SPACE.search(r[0])]):
        want = np.zeros(lm.IDS)
        for w, c in rows:
            np.add.at(want, np.frombuffer(spell[w.encode()], dtype="<u2"), c)
        assert (lm.id_counts(spark.createDataFrame(rows, "word string, c long"), path) == want).all()


def test_passages_depend_on_their_words_alone():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    ends = np.zeros(2000, dtype=bool)
    ends[[300, 1999]] = True
    starts, marks = lm.passages(h, ends)
    assert 301 in starts and 15 < len(starts) < 80
    shifted, again = lm.passages(h[120:], ends[120:])
    assert set(marks.tolist()[-10:]) <= set(again.tolist())


def test_attention_is_causal_and_sums_to_one():
    counts = np.arange(lm.IDS, dtype=float) % 97
    v = lm.Vocabulary(P.path("byte_bpe_50k.tiktoken"), counts, np.random.default_rng(3).integers(0, 9, (lm.IDS, 6)).astype(float))
    assert np.allclose(np.bincount(v.classes[: lm.START], np.exp(v.within[: lm.START]), v.size), 1, atol=1e-3)
    begins = lm.begins_word(P.path("byte_bpe_50k.tiktoken"))
    assert set(v.classes[begins]) == set(range(v.beginning)) and np.isclose(v.words.sum(), counts[begins].sum())
    model = lm.Attention(v)
    ids = np.random.default_rng(0).integers(0, 50000, 100)
    i, t = lm.windows(ids)
    assert t.ravel()[:100].tolist() == ids.tolist() and (t.ravel()[100:] == -1).all()
    logs, begin = model.score(i, t)
    logits = model.forward(i)[-1].astype(float)
    total = np.log(np.exp(logits).sum(axis=2))
    plain = np.take_along_axis(logits, v.classes[np.maximum(t, 0)][..., None].astype(int), axis=2)[..., 0] - total
    assert np.allclose(logs[t >= 0], plain[t >= 0], atol=1e-4)
    assert np.allclose(begin, np.log(np.exp(logits[..., : v.beginning]).sum(axis=2)) - total, atol=1e-4)
    changed = ids.copy()
    changed[60:] = 5
    again, _ = model.score(*lm.windows(changed))
    assert np.allclose(logs.ravel()[:60], again.ravel()[:60], atol=1e-5)


def test_slopes_are_those_of_the_loss():
    v = lm.Vocabulary(P.path("byte_bpe_50k.tiktoken"), np.arange(lm.IDS, dtype=float) % 89, np.ones((lm.IDS, 3)))
    model = lm.Attention(v)
    i, t = lm.windows(np.random.default_rng(1).integers(0, 50000, 70))

    def loss():
        logits = model.forward(i)[-1].astype(float)
        logs = np.take_along_axis(logits, v.classes[np.maximum(t, 0)][..., None].astype(int), axis=2)[..., 0] - np.log(np.exp(logits).sum(axis=2))
        return -logs[t >= 0].mean()

    slopes = model.slopes(i, t)
    for name in ("q", "k", "v", "o", "c", "p"):
        at_ = np.unravel_index(np.abs(slopes[name]).argmax(), slopes[name].shape)
        was = model.w[name][at_]
        model.w[name][at_] = was + 0.01
        up = loss()
        model.w[name][at_] = was - 0.01
        down = loss()
        model.w[name][at_] = was
        assert abs((up - down) / 0.02 - slopes[name][at_]) < 0.02 * abs(slopes[name][at_]) + 1e-4, name


def test_ann(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype("f4")
    x[:60] = x[0]
    rows = [(i, [float(a) for a in r], 0) for i, r in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0, None] * 8, 0), (2080, [1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {}
    for r in ann.op7_ann(spark, str(tmp_path)).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(float)
    hit = 0
    assert sorted(found) == list(range(0, 1500, 20))
    for q, got in found.items():
        got.sort()
        score = x @ x[q]
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(score[v] - s) < 1e-9 for _, v, s in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        best = [i for i in np.lexsort((np.arange(1500), -score.round(9))) if i != q][:20]
        hit += len(set(best) & {v for _, v, _ in got})
    assert hit >= 0.9 * 20 * len(found)
    assert {v for _, v, _ in found[0]} == set(range(1, 21))


def test_hilbert_visits_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    walk = grid[np.argsort(ann.hilbert(grid, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("run", [bpe.op1_bpe, lm.op2_lm, quality.op3_quality, langid.op4_langid, license.op5_license, packing.op6_packing, simhash.op8_simhash, sharding.op9_sharding, tokencount.op10_tokencount])
def test_empty_tables(spark, empty, run):
    assert run(spark, empty).count() == 0


def test_empty_embeddings(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert ann.op7_ann(spark, str(tmp_path)).count() == 0


def test_long_license_expressions():
    assert license.evaluate(" and ".join(["mit"] * 40 + ["gpl-2.0-only"])) == ({"mit", "gpl"}, False)
    rng = random.Random(8)
    for _ in range(3000):
        tokens = rng.choices(["mit", "gpl", "and", "or", "with", "(", ")"], k=rng.randint(0, 9))
        want = next((n for n in range(len(tokens), 0, -1) if license.postfix(tokens[:n]) is not None), 0)
        assert license.complete(tokens) == want, tokens


def test_trees_grow_into_the_new_shard_alone(spark):
    chain = [sharding.tree(1)]
    for _ in range(15):
        chain.append(sharding.grow(chain[-1]))
    fixed = [sharding.tree(n) for n in range(8, 17)]
    rows = spark.range(3000)
    for kind, trees in (("c", chain), ("f", fixed)):
        for i, t in enumerate(trees):
            rows = sharding.assign(rows, "id", t, f"{kind}{i}")
    found = rows.toPandas()
    for kind, trees in (("c", chain), ("f", fixed)):
        for i in range(1, len(trees)):
            old, new = found[f"{kind}{i - 1}"], found[f"{kind}{i}"]
            assert set(new[old != new]) == {max(sharding.shards_of(trees[i]))}
    assert found["c15"].nunique() == 16 and found["c15"].value_counts().max() < 1.5 * 3000 / 16


def test_weights_move_rows_beside_their_path_alone(spark):
    old, new = sharding.tree(8), sharding.reweighted(sharding.tree(8), {3: 3.0})
    rows = sharding.assign(sharding.assign(spark.range(12000), "id", old, "a"), "id", new, "b").toPandas()
    moved = rows[rows["a"] != rows["b"]]
    region, rack = {0, 1, 2, 3}, {2, 3}
    for a, b in zip(moved["a"], moved["b"]):
        if a in region and b in region:
            assert 3 in (a, b) or (a in rack) != (b in rack)
        else:
            assert (a in region) != (b in region)
    assert abs((rows["b"] == 3).mean() - 0.3) < 0.02 and not (sharding.assign(spark.range(2000), "id", sharding.reweighted(old, {5: 0.0})).filter("shard = 5").count())
    with pytest.raises(ValueError, match="above 0"):
        sharding.assign(spark.range(1), "id", {"r": {"k": {"s0": (0, 0.0)}}})


def test_slots_of_one_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), (F.col("id") % 2).alias("size"), F.lit(7).alias("text_crc32")).repartition(5)
    found = sharding.number(sharding.assign(rows, "doc_id", 8), "shard", "doc_id", ["size", "text_crc32"]).toPandas()
    assert all(sorted(own["slot"]) == list(range(len(own))) for _, own in found.groupby("shard")) and len(found) == 3000


def test_code_points_are_the_libraries():
    """Ids and counts of every code point that Python's tables have otherwise, and the class of all others."""
    import tiktoken
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    from lexmill.llm import tokens

    every = tokens._every()
    table = tokens.code_classes()
    for kind, pattern in ((tokens.LETTER, r"\p{L}+"), (tokens.NUMBER, r"\p{N}+"), (tokens.SPACE, r"\s+")):
        left = "".join(x for x, _ in pre_tokenizers.Split(Regex(pattern), behavior="removed").pre_tokenize_str(every))
        assert {ord(c) for c in set(every) - set(left)} == set(np.flatnonzero(table == kind).tolist())
    odd = [c for c in every if tokens._patterns()[2].match(c)]
    assert len(odd) > 1000
    shown = [f" {c}{c}'s {c}1 a{c}" for c in odd]
    want = [e.ids for e in Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(shown, add_special_tokens=False)]
    counts = tokencount.count_batch(shown, tokencount.Merger(read_ranks(P.path("byte_bpe_50k.tiktoken"))))
    assert counts.tolist() == list(map(len, want))
    encode = packing.encoder(P.path("byte_bpe_50k.tiktoken"))
    assert all(np.frombuffer(encode(x), dtype="<u2").tolist() == ids for x, ids in zip(shown, want))
    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all([i for p in pieces(x) for i in merge(p.encode(), ranks)] == e.encode_ordinary(x) for x in shown)


def test_merger_forgets_and_counts_alike(monkeypatch):
    ranks = read_ranks(P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(12)
    shown = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 3000))) for _ in range(8)] + ["the words of a text " * 40]
    want = tokencount.count_batch(shown, tokencount.Merger(ranks)).tolist()
    monkeypatch.setattr(tokencount, "MOST_STATES", 300)
    monkeypatch.setattr(tokencount, "MOST_WORDS", 5)
    small = tokencount.Merger(ranks)
    assert tokencount.count_batch(shown, small).tolist() == want == [sum(len(merge(p.encode(), ranks)) for p in pieces(t)) for t in shown]
    assert len(small.states) < 1000


@pytest.fixture(scope="module")
def long_at(spark, tmp_path_factory):
    """A text of 1 MB beside a short one."""
    rng = random.Random(2)
    long = "\n".join(" ".join(rng.choices(["word", "text", "sehr", "über", "the", "MIT", "License", "don't"], k=12)) + "." for _ in range(17_000))
    assert len(long.encode()) > 1_000_000
    path = tmp_path_factory.mktemp("long")
    spark.createDataFrame([(1, long, "en", "a", len(long)), (2, "short one", "en", "b", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path), long


@pytest.mark.parametrize("run", [bpe.op1_bpe, lm.op2_lm, quality.op3_quality, langid.op4_langid, license.op5_license, packing.op6_packing, simhash.op8_simhash, sharding.op9_sharding, tokencount.op10_tokencount])
def test_very_long_texts(spark, long_at, run):
    from tokenizers import Tokenizer

    path, long = long_at
    found = [r.asDict() for r in run(spark, path).filter("doc_id = 1").collect()]
    n = len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(long, add_special_tokens=False).ids)
    if run is packing.op6_packing:
        assert sum(r["length"] for r in found) == n + 1 == found[0]["doc_tokens"]
        return
    (r,) = found
    if run is tokencount.op10_tokencount:
        assert (r["n_tokens"], r["n_bytes"]) == (n, len(long.encode()))
    if run is bpe.op1_bpe:
        assert r["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    if run is quality.op3_quality:
        assert r["n_words"] == len(long.split()) and r["base_failed"]
    if run is license.op5_license:
        assert r["n_base"] == len(re.findall(r"(?=\bmit\s+license\b)", re.sub(r"[^a-z0-9ü\s]", " ", long.lower()))) and r["base_labels"] == "mit"
    if run is lm.op2_lm:
        assert r["n_tokens"] == len(long.split()) + 1 and math.isfinite(r["score"])
    if run is simhash.op8_simhash:
        assert r["component_id"] == 1
    if run is sharding.op9_sharding:
        assert r["text_crc32"] == zlib.crc32(long.encode())
