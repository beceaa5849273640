"""Cheapest repair of the turns of damaged conversations, by a rank-compressed dynamic program.

A repaired conversation's role initials are (s?(ua)+)?. A row's macro edit is a run of insertions with the row's own edit after it: K (keep),
R (another role) or D (delete). As codes, I...IK and so on, macros are prefix-free and in their own order, so that audit strings compare
as their first different macros do. The program therefore holds no strings: on each layer, after a row, a state has a cost, the rank of its audit among
the layer's, and a pointer to the state and macro before it. Ranks and costs less their minimum take few values, so that steps are remembered. The
audit and the repaired turns are read back along the pointers.

Rows are sorted by conversation over all tasks. What lies whole inside a task is done there. A conversation that may go on in another task, however long,
becomes segments, one a task: a segment is summed up for every state it may start from, the sums are composed in order, and each segment is then
read back between its own two states. Only hashing the repaired text goes through the segments one after the other.

Rows of a conversation are ordered by turn, nulls first; equal turns by role, then by the MD5 of the text. Null roles and texts are a space, as a
null id or turn is in the damage's key; rows without conv_id are a conversation of their own. Repeated rows are duplicates. An empty role fits no place.
Very long texts are read once and moved once, of conversations that go on three times. Empty tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import conversations, slices, written

#: States: nothing yet, after a system turn, after a user's, after an assistant's. The first and last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (START, ASSISTANT)
#: The turn that may follow a state, and where it leads; a system turn follows START alone.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Two insertions lead back to where one began, so a cheapest run has two at most.
RUN = 2
BLANKS = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}
#: Remembered steps.
STEPS = 1 << 16
#: A row's kind: its role's initial, whether it must go, whether it is truncated.
Kind = tuple[str, bool, bool]
#: For each cell (start, state): cost and rank, or None where no edits lead there.
Layer = tuple[tuple[int, int] | None, ...]


def after(state: int, initial: str) -> int | None:
    """The state after a turn, None where it may not follow."""
    if initial == "s":
        return SYSTEM if state == START else None
    letter, to = NEXT[state]
    return to if letter == initial else None


def runs(state: int) -> list[tuple[int, int]]:
    """(insertions, state after them)."""
    out = [(0, state)]
    for k in range(RUN):
        out.append((k + 1, NEXT[out[-1][1]][1]))
    return out


@cache
def macros(kind: Kind) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, code): the cheapest macro between two states, of equal ones the ASCII-least."""
    initial, must_go, truncated = kind
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in STATES:
        for k, at in runs(state):
            edits = [(at, DELETE, "D")]
            if not must_go:
                edits += [(after(at, initial), 0, "K"), *((after(at, x), REROLE, "R") for x in ROLES)]
            for to, cost, code in edits:
                if to is not None:
                    found = (INSERT * k + cost + (TRUNCATED if truncated and code != "D" else 0), "I" * k + code)
                    best[state, to] = min(best.get((state, to), found), found)
    return tuple((a, b, *x) for (a, b), x in best.items())


def closing(state: int) -> tuple[int, str]:
    """The cheapest insertions after the last row."""
    return next((INSERT * k, "I" * k) for k, at in runs(state) if at in ENDS)


def ranked(found: list[tuple[int, tuple] | None]) -> Layer:
    """Costs as they are; in place of what the audits are compared by, ranks."""
    order = {x: i for i, x in enumerate(sorted({f[1] for f in found if f is not None}))}
    return tuple(None if f is None else (f[0], order[f[1]]) for f in found)


def first_layer(starts: Iterable[int]) -> Layer:
    return tuple((0, 0) if state == start else None for start in starts for state in STATES)


@lru_cache(STEPS)
def stepped(layer: Layer, kind: Kind) -> tuple[int, Layer, tuple]:
    """(least cost, layer after a row with costs above the least, pointers): a pointer is the state before and the macro."""
    found: list = [None] * len(layer)
    pointers: list = [None] * len(layer)
    for base in range(0, len(layer), len(STATES)):
        for a, b, cost, code in macros(kind):
            if layer[base + a] is not None:
                paid, rank = layer[base + a]
                new = (paid + cost, (rank, code))
                if found[base + b] is None or new < found[base + b]:
                    found[base + b], pointers[base + b] = new, (a, code)
    least = min(f[0] for f in found if f is not None)
    return least, ranked([None if f is None else (f[0] - least, f[1]) for f in found]), tuple(pointers)


class Program:
    """The layers of some rows from each of `starts`, as pointers."""

    def __init__(self, kinds: list[Kind], starts: Iterable[int] = (START,)):
        self.starts, self.pointers, self.base, self.last = list(starts), [], 0, first_layer(starts)
        for kind in kinds:
            least, self.last, pointers = stepped(self.last, kind)
            self.base += least
            self.pointers.append(pointers)

    def codes(self, start: int, state: int) -> list[str]:
        """The macros that lead from start to state, in the order of rows."""
        base, out = self.starts.index(start) * len(STATES), []
        for pointers in reversed(self.pointers):
            state, code = pointers[base + state]
            out.append(code)
        return out[::-1]

    def ending(self) -> tuple[int, int, str]:
        """(cost, last state, closing insertions) of the best end, from the first start."""
        ends = [(self.last[s][0] + closing(s)[0], self.last[s][1], closing(s)[1], s) for s in STATES if self.last[s] is not None]
        cost, _, code, state = min(ends)
        return self.base + cost, state, code


def inserted(state: int, n: int) -> tuple[list[str], int]:
    out = []
    for _ in range(n):
        letter, state = NEXT[state]
        out.append(f"{ROLES[letter]}:")
    return out, state


def applied(rows: list[tuple[str, str]], codes: list[str], state: int) -> tuple[list[str], int]:
    """The repaired turns, as role:text, of rows (role, text) edited by codes from a state on, and the state after them."""
    out = []
    for (role, text), code in zip(rows, codes, strict=True):
        more, state = inserted(state, len(code) - 1)
        out += more
        if code[-1] == "K":
            out.append(f"{role}:{text}")
            state = after(state, role[:1])
        elif code[-1] == "R":
            letter, state = NEXT[state]
            out.append(f"{ROLES[letter]}:{text}")
    return out, state


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, dropped) after the damage; a dropped row stays as a mark of its conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).cast("int")
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    made = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fate.alias("fate"))
    made = made.select("conv_id", "turn", role.alias("role"), text.alias("text"), "fate").withColumn("digest", F.md5(F.col("text").cast("binary")))
    return made.withColumn("dropped", F.col("fate") == 0).withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "copy")


class Counts:
    """What is counted along rows in order; parts can be added up."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "first", "last")

    def __init__(self, blank=0, duplicate=0, truncated=0, illegal=0, turns=0, least=None, most=None, first=None, last=None):
        self.blank, self.duplicate, self.truncated, self.illegal, self.turns = blank, duplicate, truncated, illegal, turns
        self.least, self.most, self.first, self.last = least, most, first, last

    def row(self, turn, role: str, text: str, seen: bool) -> Kind:
        """Count a row and say its kind."""
        end = text.rstrip(BLANKS)[-1:]
        blank, cut = not end, bool(end) and end not in ".!?"
        cut = cut and not seen
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut
        initial = role[:1]
        self.illegal += self.first is not None and self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        return initial if initial in ("s", "u", "a") else "", blank or seen, cut

    def add(self, more: Counts) -> None:
        self.blank, self.duplicate, self.truncated = self.blank + more.blank, self.duplicate + more.duplicate, self.truncated + more.truncated
        if more.first is not None:
            self.illegal += more.illegal + (self.first is not None and self.last + more.first not in LEGAL)
            self.first, self.last = more.first if self.first is None else self.first, more.last
        if more.least is not None:
            self.turns += more.turns - (more.least == self.most)
            self.least, self.most = more.least if self.least is None else self.least, more.most

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns

    def results(self) -> list[int]:
        return [self.gaps, self.blank, self.duplicate, self.truncated, self.illegal]


RESULTS = [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
ROW = [T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("dropped", T.BooleanType())]
#: The fields of a segment's sum: counts, then cost and rank of each (start, state), null where nothing leads there.
SUM = [T.StructField(n, T.LongType()) for n in Counts.FIELDS[:7]] + [T.StructField(n, T.StringType()) for n in Counts.FIELDS[7:]] + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("costs", "ranks")]


def shape(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def repaired(rows: list[tuple]) -> list:
    """The results for a whole conversation's rows (turn, role, text, digest, dropped, again)."""
    counts, live = Counts(), [r for r in rows if not r[4]]
    program = Program([counts.row(turn, role, text, again) for turn, role, text, _, _, again in live])
    cost, state, tail = program.ending()
    codes = program.codes(START, state)
    turns, state = applied([(r[1], r[2]) for r in live], codes, START)
    turns += inserted(state, len(tail))[0]
    return [*counts.results(), cost, "".join(codes) + tail, hashlib.sha256("\n".join(turns).encode()).hexdigest()]


def through_tasks(rows: DataFrame) -> DataFrame:
    """Rows sorted over all tasks: results of conversations inside one, and the rows (open) of a task's first and last conversation."""
    source = rows.schema
    schema = T.StructType([T.StructField("open", T.BooleanType()), source["conv_id"], T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), source["turn"], *ROW, T.StructField("again", T.BooleanType()), *RESULTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema, width = shape(schema), len(RESULTS)
        conv, held, seen, at, firsts = None, [], set(), 0, True  # firsts: the first conversation of this task

        def opened(part: int) -> list:
            return [[True, conv, part, n, *row, *[None] * width] for n, row in held]

        part = None
        for b in batches:
            for s in slices([b]):
                out = []
                for key, part, turn, role, text, digest, dropped in zip(*(s.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text", "digest", "dropped")), strict=True):
                    if not at:
                        conv = key
                    if key != conv:
                        if firsts:
                            out += opened(part)
                        else:
                            out.append([False, conv, *[None] * 8, *repaired([row for _, row in held])])
                        conv, held, seen, firsts = key, [], set(), False
                    again = not dropped and (role, digest) in seen
                    if not dropped:
                        seen.add((role, digest))
                    held.append((at, (turn, role, text, digest, dropped, again)))
                    at += 1
                if firsts and held:
                    out, held = out + opened(part), []
                yield batch(out, out_schema)
        if held:
            yield batch(opened(part), out_schema)

    return rows.mapInArrow(run, schema)


def _rows_of(table: pa.Table) -> list[tuple]:
    """A segment's live rows in order: (turn, role, text, again)."""
    return list(zip(*(table.sort_by("at").filter(pa.compute.invert(table.sort_by("at").column("dropped"))).column(c).to_pylist() for c in ("turn", "role", "text", "again")), strict=True))


def summed(segments: DataFrame) -> DataFrame:
    """(conv_id, part, SUM...) of segments (conv_id, part, at, turn, role, text, dropped, again)."""
    schema = T.StructType([segments.schema["conv_id"], segments.schema["part"], *SUM])

    def run(key, table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        counts = Counts()
        program = Program([counts.row(*r) for r in _rows_of(table)], STATES)
        cells = [(None, None) if c is None else (program.base + c[0], c[1]) for c in program.last]
        return pa.Table.from_batches([batch([[key[0].as_py(), key[1].as_py(), *(getattr(counts, f) for f in Counts.FIELDS), [c for c, _ in cells], [r for _, r in cells]]], shape(schema))])

    return segments.groupBy("conv_id", "part").applyInArrow(lambda key, table: run(key, table), schema)


def composed(sums: DataFrame) -> DataFrame:
    """(conv_id, part, enter, leave, tail, gaps ... cost): the states between which each segment is read back, and the whole conversation's figures."""
    schema = T.StructType([sums.schema["conv_id"], sums.schema["part"], T.StructField("enter", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("tail", T.StringType()), *RESULTS[:6]])

    def run(key, table: pa.Table) -> pa.Table:
        segments, total, layer, pointers = table.sort_by("part").to_pylist(), Counts(), first_layer([START]), []
        for s in segments:
            total.add(Counts(**{f: s[f] for f in Counts.FIELDS}))
            found: list = [None] * len(STATES)
            came: list = [None] * len(STATES)
            for a in STATES:
                for b in STATES:
                    i = a * len(STATES) + b
                    if layer[a] is not None and s["costs"][i] is not None:
                        new = (layer[a][0] + s["costs"][i], (layer[a][1], s["ranks"][i]))
                        if found[b] is None or new < found[b]:
                            found[b], came[b] = new, a
            layer = ranked(found)
            pointers.append(came)
        cost, _, tail, state = min((layer[s][0] + closing(s)[0], layer[s][1], closing(s)[1], s) for s in STATES if layer[s] is not None)
        path = []
        for came in reversed(pointers):
            path.append((came[state], state))
            state = came[state]
        rows = [[key[0].as_py(), s["part"], a, b, "", *total.results(), cost] for s, (a, b) in zip(segments, path[::-1], strict=True)]
        rows[-1][4] = tail
        return pa.Table.from_batches([batch(rows, shape(schema))])

    return sums.groupBy("conv_id").applyInArrow(lambda key, table: run(key, table), schema)


def read_back(segments: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, part, gaps ... cost, audit, turns, lines): each segment's piece of the audit and of the repaired text."""
    schema = T.StructType([segments.schema["conv_id"], segments.schema["part"], *RESULTS[:7], T.StructField("turns", T.StringType()), T.StructField("lines", T.LongType())])

    def run(key, rows: pa.Table, plan: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        live, p = _rows_of(rows), plan.to_pylist()[0]
        counts = Counts()
        codes = Program([counts.row(*r) for r in live], [p["enter"]]).codes(p["enter"], p["leave"])
        turns, state = applied([(r[1], r[2]) for r in live], codes, p["enter"])
        turns += inserted(state, len(p["tail"]))[0]
        figures = [p[f.name] for f in RESULTS[:6]]
        return pa.Table.from_batches([batch([[key[0].as_py(), key[1].as_py(), *figures, "".join(codes) + p["tail"], "\n".join(turns), len(turns)]], shape(schema))])

    return segments.groupBy("conv_id", "part").cogroup(plan.groupBy("conv_id", "part")).applyInArrow(lambda key, rows, plan: run(key, rows, plan), schema)


def joined(pieces: DataFrame) -> DataFrame:
    """(conv_id, RESULTS...) of pieces; a conversation's pieces pass in order, one at a time."""
    schema = T.StructType([pieces.schema["conv_id"], *RESULTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema, current = shape(schema), None
        done = lambda c: batch([[c[0], *c[1], "".join(c[2]), c[3].hexdigest()]], out_schema)
        for b in batches:
            for s in slices([b], 1):
                r = s.to_pylist()[0]
                if current is None or current[0] != r["conv_id"]:
                    if current is not None:
                        yield done(current)
                    current = (r["conv_id"], [r[f.name] for f in RESULTS[:6]], [], hashlib.sha256(), [])
                current[2].append(r["audit"])
                if r["lines"]:
                    current[3].update((("\n" if current[4] else "") + r["turns"]).encode())
                    current[4][:] = [True]
        if current is not None:
            yield done(current)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, RESULTS...) of rows (conv_id, turn, role, text, digest, dropped): every conversation in its cheapest repair."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest"]
    spread = rows.withColumn("salt", F.monotonically_increasing_id())  # rows that are equal may lie in any order, and in several tasks
    placed = spread.repartitionByRange(parts, *order, "salt").sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    found = written(through_tasks(placed.drop("salt")), "repaired")
    names = ["conv_id", *[f.name for f in RESULTS]]
    rest = found.filter("open").select("conv_id", "part", "at", "turn", *[f.name for f in ROW], "again")
    # What a conversation said in an earlier segment: only first places of a text in a segment meet.
    several = rest.filter("not dropped and not again").groupBy("conv_id", "role", "digest").agg(F.min("part").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    r, s = rest.alias("r"), several.alias("s")
    same = F.expr("r.conv_id <=> s.conv_id and r.role = s.role and r.digest = s.digest and not r.again")
    segments = written(r.join(s, same, "left").select("r.*", "s.first").withColumn("again", F.col("again") | F.coalesce(~F.col("dropped") & (F.col("first") < F.col("part")), F.lit(False))).drop("first"), "segments")
    plan = written(composed(written(summed(segments), "sums")), "plan")
    return found.filter("not open").select(names).unionByName(joined(read_back(segments, plan)).select(names))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gaps, faults, illegal neighbours, cost, audit and repaired_sha256 of every conversation."""
    return repair(damaged(conversations(spark, sf_dir)))
