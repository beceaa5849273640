"""Cuckoo filters, and the index against plain groups after insertions and deletions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.llm import cuckoo

TEXTS = [None, "", " ", "\t\n ", "a b", "a  b", "a\tb ", "a b ", "a b", "x" * 300_000, "y z " * 50_000, *[f"text {i % 7}" for i in range(40)]]
SCHEMA = "doc_id long, text string, kept string, digest string, n long"


def key(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).digest()


def plain(rows):
    """[(doc_id, keep_id, size, kept, hash)] of (doc_id, text), kept once in each group."""
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append(i)
    out = []
    for k, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), j == 0, k.hex()) for j, i in enumerate(ids)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "mine", "mine", 1) for i, t in rows], SCHEMA).repartition(3)


def answers(index):
    return sorted(((r["doc_id"], r["keep_id"], r["n"], r["row"] == r["keep_row"], r["digest"].hex()) for r in index.resolved().collect()), key=str)


def test_filter():
    rng = random.Random(1)
    keys = [rng.randbytes(32) for _ in range(3000)]
    f = cuckoo.Filter(1024)
    assert all(map(f.insert, keys)) and all(k in f for k in keys)
    assert sum(rng.randbytes(32) in f for _ in range(20_000)) < 20  # false hits: 8 marks of 16 bits are looked at
    assert all(f.delete(k) for k in keys[:1500]) and all(k in f for k in keys[1500:]) and sum(k in f for k in keys[:1500]) < 5


def test_overflow_and_false_hits():
    """Digests of one mark and cell stay apart; many others force the filter to grow."""
    rng = random.Random(2)
    b = cuckoo.Bucket({})
    keys = [rng.randbytes(32) for _ in range(5000)] + [bytes(10) + bytes([i]) * 22 for i in range(8)]
    for i, k in enumerate(keys):
        b.add(k, (False, i, i), 1)
    assert len(b.content) == 5008 and b.filter.mask + 1 > cuckoo.CELLS and all(k in b.filter for k in keys)
    assert all(n == 1 for _, n in b.content.values())  # eight of one mark hit the filter and are still texts of their own
    b.add(keys[-1], (False, -1, 9), 2)
    assert b.content[keys[-1]] == ((False, -1, 9), 3)
    for k in keys[:-1]:
        b.replace(k, (), 0)
    assert list(b.content) == [keys[-1]] and keys[-1] in b.filter and sum(map(bool, b.filter.marks)) == 1
    b.replace(b"\1" * 32, (), 5)
    assert len(b.content) == 1


def test_query(spark, tmp_path):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5])] * 2
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in cuckoo.op12_cuckoo(spark, str(tmp_path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert found == plain(rows)


def test_empty(spark, tmp_path):
    frame(spark, [(1, "a")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cuckoo.op12_cuckoo(spark, str(tmp_path)).count() == 0


def test_insertions_and_deletions(spark, monkeypatch):
    monkeypatch.setattr(cuckoo, "BUCKETS", 2)
    monkeypatch.setattr(cuckoo, "PLANNED", 16)  # so that buckets are added
    monkeypatch.setattr(cuckoo, "FREQUENT", 2)
    rng, live = random.Random(3), []
    index = cuckoo.Index.of(cuckoo.digests(frame(spark, [(0, "x")]).limit(0)))
    for step in range(3):
        more = [(rng.choice([None, rng.randint(0, 99)]), rng.choice(TEXTS[:9] + [f"{x}" for x in range(20)])) for _ in range(30)]
        index = index.insert(cuckoo.digests(frame(spark, more), (step + 1) << 50))
        live += more
        assert answers(index) == plain(live)
        gone = rng.sample(live, 12) + [(12345, "never there")]
        index = index.delete(cuckoo.digests(frame(spark, gone)))
        live = [(i, t) for i, t in live if (i, key(t)) not in {(a, key(b)) for a, b in gone}]
        assert answers(index) == plain(live)
        marks = sum(sum(map(bool, cuckoo.Filter(marks=bytes(r["marks"])).marks)) for r in index.filters().collect())
        assert marks == len({key(t) for _, t in live}) == index.groups().count()
    assert index.buckets > 2
    everything = index.delete(cuckoo.digests(frame(spark, live)))
    assert answers(everything) == [] and everything.groups().count() == 0 and answers(index) == plain(live)
    assert everything.rows.count() == 0 and index.rows.agg(F.count("row")).first()[0] == len(live)


@pytest.mark.parametrize("cells", [1, 4])
def test_full_filter_says_so(cells):
    rng = random.Random(4)
    f = cuckoo.Filter(cells)
    assert not all([f.insert(rng.randbytes(32)) for _ in range(cells * cuckoo.SLOTS + 1)])
