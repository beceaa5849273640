"""The trie against a plain one of all prefixes, in one task and in many."""

import hashlib
import math
import random
import zlib

from pyspark.sql import functions as F

from lexmill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, part string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def token(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], len(text)


def plain(rows):
    """Nodes of rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, *token(role or "", text or "")))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    members, ends = {}, {}
    for c in sorted(own):  # % as in SQL: the sign of the id
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (node[-1][1] if node else 0)
    hashed = lambda node: hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
    return sorted(((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], hashed(n)) for n, m in members.items()), key=str)


def made(rng, convs):
    rows, openings = [], [[("user", "Hi"), ("assistant", "Hello."), ("user", "And?")], [("system", "Be brief."), ("user", "Hi")]]
    for c in convs:
        said = list(rng.choice(openings)[: rng.randint(0, 3)]) + [("user", rng.choice("abü")) for _ in range(rng.randint(0, 4))]
        rows += [(c, turn if rng.random() > 0.02 else None, role, text) for turn, (role, text) in enumerate(said)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], SCHEMA).repartition(3)


def answers(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark, tmp_path):
    rng = random.Random(1)
    rows = made(rng, rng.sample(range(1000), 300))
    rows += rows[:9] + [(None, 1, "user", "nobody"), (5, None, None, None), (5, 900, "user", "long " * 100_000), (-5, 0, "user", "Hi"), (-100, 0, "user", "Hi")]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert answers(trie.op11_trie(spark, str(tmp_path))) == sorted(plain([r for r in rows]), key=str)


def test_many_tasks(spark, monkeypatch):
    """Equal conversations and a common opening lie in many tasks, however the cuts fall; joins with and without a broadcast."""
    rng = random.Random(2)
    for case in range(3):
        rows = made(rng, rng.sample(range(3000), 200)) + [(c, t, "user", "same") for c in range(5000, 5150) for t in range(case)]
        want = plain(rows)
        monkeypatch.setattr(trie, "PLANNED", (7, 23, 60)[case])
        monkeypatch.setattr(trie, "BROADCAST_CHARS", (0, 10**6, 10**6)[case])
        assert answers(trie.nodes(trie.rebuilt(trie.sequences(frame(spark, rows))))) == want


def test_one_conversation_and_none(spark):
    one = [(7, t, "user", str(t)) for t in range(30)]
    assert answers(trie.nodes(trie.rebuilt(trie.sequences(frame(spark, one))))) == plain(one)
    assert trie.nodes(trie.rebuilt(trie.sequences(frame(spark, one).filter(F.lit(False))))).count() == 0


def test_turnless(spark):
    """Conversations without any turn end at the root."""
    keys = spark.createDataFrame([(3, ""), (4, ""), (5, "0" * 39 + "9")], "conv_id long, key string")
    end = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    assert answers(trie.nodes(keys)) == sorted([(3, 0, None, 3, 1, 1, 0, end("3,4")), (5, 1, 3, 1, 0, 1, 0, end("5"))], key=str)
