"""Repairs against all edits of short conversations, and long conversations in segments."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from lexmill.llm import repair

sys.setrecursionlimit(10_000)
BLANK = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, at long, part string, open string, digest string"


def harmed(rows):
    """{conv: [(turn, role, text)]} after the damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def plain(rows):
    """The results of one conversation's rows by trying everything, with whole strings."""
    seen, kinds, faults = set(), [], [0, 0, 0]
    for _, role, text in rows:
        blank, again = not text.strip(BLANK), (role, text) in seen
        cut = not blank and not again and text.rstrip(BLANK)[-1] not in ".!?"
        seen.add((role, text))
        for i, x in enumerate((blank, again and not blank, cut)):
            faults[i] += x
        kinds.append((blank or again, cut))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    @cache
    def best(i, so_far, ahead):
        """(cost, audit, turns) from row i on, where the last initial is so_far and `ahead` insertions have just been made."""
        found = []
        if i == len(rows) and so_far in ("", "a"):
            found.append((0, "", ()))
        if ahead < 2:
            for x, role in (("u", "user:"), ("a", "assistant:")):
                if (so_far + x) in ("u", "su", "ua", "au"):
                    c, a, t = best(i, x, ahead + 1)
                    found.append((2 + c, "I" + a, (role, *t)))
        if i < len(rows):
            gone, cut = kinds[i]
            _, role, text = rows[i]
            c, a, t = best(i + 1, so_far, 0)
            found.append((3 + c, "D" + a, t))
            if not gone:
                for new, cost, name in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if (so_far + new[:1]) in ("s", "u", "su", "ua", "au") and len(new) and len(so_far + new[:1]) == len(so_far) + 1:
                        c, a, t = best(i + 1, new[:1], 0)
                        found.append((cost + cut + c, name + a, (f"{new}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    cost, audit, turns = best(0, "", 0)
    return [gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()]


def conversation(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "a"]), rng.choice(["One.", "Two!", "Three", "", " \n", "Four? ", "five", f"{rng.random()}.", f"{rng.random()}"])) for _ in range(n)]


def answers(df):
    return {r["conv_id"]: [r[f.name] for f in repair.RESULTS] for r in df.collect()}


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "mine", "mine", "mine") for r in rows], SCHEMA).repartition(parts)


def test_query(spark, tmp_path):
    rng, rows = random.Random(1), []
    for conv in [*range(60), None]:
        for turn, (role, text) in enumerate(conversation(rng, rng.randint(1, 9))):
            if rng.random() > 0.1:
                rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role if rng.random() > 0.05 else None, text if rng.random() > 0.05 else None))
    rows += rows[:5] + [(900, t, "user", "x") for t in range(1, 60) if zlib.crc32(f"900:{t}".encode()) % 20 == 0]  # a conversation of which nothing is left
    rows.append((901, 7, "user", "long. " * 200_000))
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    found = answers(repair.op13_repair(spark, str(tmp_path)))
    want = {conv: plain(kept) for conv, kept in harmed(rows).items()}
    assert found == want
    assert found[900] == [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]


def test_long_conversations_in_segments(spark):
    """Two conversations that go through many tasks, with texts said in several of them, have the results they have in one."""
    rng = random.Random(2)
    rows = [(conv, turn, role, text) for conv, n in ((1, 500), (2, 7), (3, 300), (4, 1)) for turn, (role, text) in enumerate(conversation(rng, n))]
    rows += [(5, 1, "user", "the same.")] * 200  # equal in everything that orders them
    want = {conv: plain(kept) for conv, kept in harmed(rows).items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert answers(repair.repair(repair.damaged(frame(spark, rows)))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty(spark):
    assert repair.repair(repair.damaged(frame(spark, [(1, 1, "user", "x")]).filter(F.lit(False)))).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_segments_compose(seed):
    """Sums of segments, composed, give the cost of the whole; whatever the cut."""
    rng = random.Random(seed)
    kinds = [(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 12))]
    whole, cut = repair.Program(kinds), rng.randint(0, len(kinds))
    first, second = repair.Program(kinds[:cut]), repair.Program(kinds[cut:], repair.STATES)
    through = [first.base + first.last[a][0] + second.base + second.last[4 * a + b][0] + repair.closing(b)[0] for a in repair.STATES for b in repair.STATES if first.last[a] and second.last[4 * a + b]]
    assert whole.ending()[0] == min(through)
