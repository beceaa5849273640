"""The self-join of sets against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import selfjoin


def sets_of(spark, rows):
    return spark.createDataFrame([(i, sorted(map(int, s))) for i, s in enumerate(rows)], "node long, tokens array<long>").repartition(3)


def all_pairs(rows, t):
    out = set()
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a and len(a & b) / len(a | b) >= t - 1e-9:
                out.add(frozenset((i, j)))
    return out


@pytest.mark.parametrize("t", [0.5, 0.8, 0.92])
def test_no_pair_is_lost(spark, t):
    """Random sets, sets of one template with many own tokens, and chains of near copies."""
    rng = random.Random(int(t * 100))
    rows = [set(rng.sample(range(60), rng.randint(1, 20))) for _ in range(80)] + [set(), {1}, {1, 2}]
    template = set(range(1000, 1100))
    rows += [set(rng.sample(sorted(template), rng.randint(70, 100))) | {rng.randint(5000, 9000) for _ in range(rng.randint(0, 25))} for _ in range(60)]
    rows = list({frozenset(r): r for r in rows}.values())
    sets = sets_of(spark, rows)
    for order in (selfjoin.order_of(sets.select(F.explode("tokens").alias("token"))), selfjoin.Order(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))):
        found = selfjoin.candidates(selfjoin.prefixes(sets, order, t), t)
        links = selfjoin.verified(found, sets, t).collect()
        assert {frozenset((r["a"], r["b"])) for r in links} == all_pairs(rows, t) and len(links) == len(all_pairs(rows, t))


def test_templates_do_not_meet(spark):
    """400 texts of one template, each with a fifth of its own: all pairs share most tokens, and none is looked at."""
    rows = [set(range(100)) | {1000 * (i + 1) + k for k in range(26)} for i in range(400)]
    sets = sets_of(spark, rows)
    order = selfjoin.order_of(sets.filter("node % 16 = 0").select(F.explode("tokens").alias("token")))
    assert len(order.tokens) == 100 and selfjoin.candidates(selfjoin.prefixes(sets, order)).count() == 0


def test_documents(spark):
    """Null, empty and very long texts, repeated rows and ids, and clashing names."""
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [None, "", " \n", "one two", "ONE two", "one", long, long + " more", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y z end", "a B c d e f g h i j k l m n o p q r s t u v w x y z"]
    docs = spark.createDataFrame([(i if i != 9 else None, t, 1, "mine", "mine") for i, t in enumerate(texts)] + [(6, long, 1, "mine", "mine")], "doc_id long, text string, node int, key string, tokens string")
    found = sorted(map(tuple, selfjoin.linked(docs).select("doc_id", "class_id", "class_size", "n_links", "linked_rows").collect()), key=str)
    want = [(0, 0, 3, 0, 0), (1, 0, 3, 0, 0), (2, 0, 3, 0, 0), (3, 3, 2, 0, 0), (4, 3, 2, 0, 0), (5, 5, 1, 0, 0), (6, 6, 2, 1, 1), (6, 6, 2, 1, 1), (7, 7, 1, 1, 2), (8, 8, 2, 1, 1), (10, 8, 2, 1, 1), (None, None, 1, 1, 2)]
    assert found == sorted(want, key=str)
    assert selfjoin.linked(docs.limit(0)).count() == 0


def test_only_sets_that_may_be_similar_are_shuffled(spark, monkeypatch):
    """Pairs that share their rarest tokens and too few others are dropped by their bins; all pairs of similar sets stay, with few bins filled and with many, told or not."""
    rng = random.Random(3)
    rows = [{*range(10 * (i // 4), 10 * (i // 4) + 10), *rng.sample(range(10_000, 90_000), 40)} for i in range(80)]
    rows += [r ^ {99_999 + i} for i, r in enumerate(rows[:20])] + [{256 * k for k in range(50 + i)} for i in range(6)]
    sets = sets_of(spark, rows)
    order = selfjoin.Order(np.array(sorted(x for x in range(10_000, 90_000))), np.arange(80_000) + 1)
    signed = selfjoin.signatures(sets, order, 0.8)
    pairs = selfjoin.candidates(selfjoin.placed(signed), 0.8)
    kept = selfjoin.alike(pairs, signed, 0.8)
    assert kept.count() < pairs.count() / 2
    for told in (1_000_000, 0):
        monkeypatch.setattr(selfjoin, "TOLD", told)
        assert {frozenset((r["a"], r["b"])) for r in selfjoin.verified(kept, sets, 0.8).collect()} == all_pairs(rows, 0.8)


def test_sets_are_written_once(spark, monkeypatch):
    seen, was = [], selfjoin.written
    monkeypatch.setattr(selfjoin, "written", lambda df, name: (seen.append((name, df.columns)), was(df, name))[1])
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 3, 60))) for i in range(9)], "doc_id long, text string")
    found = selfjoin.linked(docs).collect()
    assert [name for name, columns in seen if "tokens" in columns] == ["sets"]
    assert {(r["class_size"], r["n_links"], r["linked_rows"]) for r in found} == {(3, 2, 6)}
