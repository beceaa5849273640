"""Mixture-controlled packing by deficit round-robin.

Each source has a queue of its documents' tokens. In every window each queue that has tokens left gets a quantum, its
target share of the window; what it can't take in whole tokens is its deficit and carries over to the next window. Counted
from the start, a queue has had its quanta to within half a token at every window's end, so the counts after any window follow from
the shares and the queues' lengths alone: partitions place their own documents, and deficits carry across windows and
partitions without a sequential pass. When a queue ends, the others share its part in proportion.

Targets are shares by source; sources without one share what is left, in proportion to their tokens, and wait for the others' end if
nothing is left. Without targets that is every source's natural share, and all queues end together. A window has WINDOW sequences
or one for every source, whichever is more, so that many sources don't shred documents. Windows follow each other without gaps
and are cut into sequences; only the last sequence is padded.

Null and empty texts have the end token only. A null source is a source of its own. Repeated rows are packed as often
as they occur; very long texts run through many windows. Empty tables give empty results; other columns than doc_id, text and source don't matter,
whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_text, documents, let, slices, written
from .tokens import Encoder, read_ranks

SEQUENCE = 1024
#: Sequences of a window, at least.
WINDOW = 64
SPECIAL, SPECIAL_ID, END_ID = "<|endoftext|>", 50256, 0
#: Starts of queues and of slices are broadcast up to so many rows (some MB), and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
#: Windows that are listed or added up at a time.
BLOCK = 4096


def encoder(path: str):
    """A function from text to its ids as little-endian 16-bit integers, the special string as its own id, as `tokenizers` has them."""
    import tiktoken

    #: Each word is matched alone already, so here it is one piece.
    words = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})
    plain = Encoder(lambda word: array("H", words.encode_ordinary(word)).tobytes())
    special = np.array([SPECIAL_ID], dtype="<u2").tobytes()

    def encode(text: str) -> bytes:
        if SPECIAL in text:
            return special.join(map(plain, text.split(SPECIAL)))
        return plain(text)

    return encode


def schedule(totals: dict[str, int], shares: dict[str, float]) -> tuple[list[float], dict[str, tuple[list[float], list[float]]]]:
    """Phases between ends of groups of queues: (how many tokens are served when each begins, {group: (its tokens by then, its rate)})."""
    times: list[float] = []
    rows: dict[str, tuple[list[float], list[float]]] = {g: ([], []) for g in totals}
    served, left, now = dict.fromkeys(totals, 0.0), {g for g, n in totals.items() if n}, 0.0
    while left:
        wanted = {g: shares[g] for g in left if shares[g] > 0} or {g: totals[g] for g in left}
        rates = {g: w / sum(wanted.values()) for g, w in wanted.items()}
        times.append(now)
        for g, (counts, rate) in rows.items():
            counts.append(served[g]), rate.append(rates.get(g, 0.0))
        span = min((totals[g] - served[g]) / r for g, r in rates.items())
        now += span
        for g, r in rates.items():
            served[g] += r * span
            if totals[g] - served[g] < 0.5:
                served[g] = float(totals[g])
                left.remove(g)
    return times, rows


class Rounds:
    """What a queue has had when a window begins, and in which window a token falls, as Columns over a queue's row.

    The row has `total` (its tokens), `whole` (those of its group), `counts` and `rates` (its group's phases)."""

    def __init__(self, times: list[float], tokens: int, size: int):
        self.times, self.tokens, self.size = F.array(*map(F.lit, times)), tokens, size
        self.phases = F.array(*map(F.lit, range(len(times))))
        self.windows = -(-tokens // size)

    def served(self, window: Column) -> Column:
        def at(x: Column) -> Column:
            k = F.size(F.filter(self.times, lambda t: t <= x)) - 1
            due = (F.get("counts", k) + F.get("rates", k) * (x - F.get(self.times, k))) * (F.col("total") / F.col("whole"))
            return F.when(window >= self.windows, F.col("total")).otherwise(F.least(F.col("total"), F.ceil(due - 0.5)))

        return let((window * self.size).cast("double"), at).cast("long")

    def window(self, token: Column) -> Column:
        y = (token + 0.5) * F.col("whole") / F.col("total")
        k = F.element_at(F.filter(self.phases, lambda k: (k == 0) | (F.get("counts", k) <= y) & (F.get("rates", k) > 0)), -1)
        about = lambda k: F.get(self.times, k) + F.coalesce((y - F.get("counts", k)) / F.nullif(F.get("rates", k), F.lit(0.0)), F.lit(0.0))
        near = F.least(F.greatest(F.floor(let(k, about) / self.size), F.lit(0)), F.lit(self.windows - 1)).cast("long")
        # Rounding may put it one off.
        return let(near, lambda w: w - (self.served(w) > token).cast("long") + (self.served(w + 1) <= token).cast("long"))


def _running(by: list, *over) -> Column:
    return F.coalesce(F.sum("_n").over(Window.partitionBy(*over).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def slices_of(queues: DataFrame, rounds: Rounds) -> DataFrame:
    """(queue, window, first, position): the queue's first token in each window that has some, and its place among all tokens."""
    ends = queues.withColumns({"low": rounds.window(F.lit(0).cast("long")), "high": rounds.window(F.col("total") - 1)})
    blocks = ends.withColumn("block", F.explode(F.sequence(F.expr(f"low div {BLOCK}"), F.expr(f"high div {BLOCK}"))))
    each = F.sequence(F.greatest("low", F.col("block") * BLOCK), F.least("high", F.col("block") * BLOCK + (BLOCK - 1)))
    counted = blocks.withColumn("window", F.explode(each)).withColumns({"first": rounds.served(F.col("window")), "_n": rounds.served(F.col("window") + 1)})
    found = counted.withColumn("_n", F.col("_n") - F.col("first")).filter("_n > 0").select("queue", "window", "block", "first", "_n")
    sizes = found.groupBy("block", "window").agg(F.sum("_n").alias("_n"))
    ahead = sizes.groupBy("block").agg(F.sum("_n").alias("_n")).select("block", _running(["block"]).alias("_block"))
    begins = sizes.withColumn("_in_block", _running(["window"], "block")).join(ahead, "block").select("window", (F.col("_block") + F.col("_in_block")).alias("_begin"))
    inside = found.withColumn("_inside", _running(["queue"], "window"))
    return inside.join(begins, "window").select("queue", "window", "first", (F.col("_begin") + F.col("_inside")).alias("position"))


def pack(docs: DataFrame, path: str, targets: dict[str | None, float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece; ids are little-endian 32-bit integers.

    targets: shares by source, 1 in all at most."""
    named = {"" if s is None else f"={s}": float(p) for s, p in (targets or {}).items()}
    if min(named.values(), default=0) < 0 or sum(named.values()) > 1 + 1e-9:
        raise ValueError("targets are shares: none below 0, 1 in all at most")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(path), np.array([END_ID], dtype="<u2").tobytes()
        part, so_far = TaskContext.get().partitionId(), {}
        for b in slices(batches):
            ids, starts = [encode(x) + end for x in as_text(b.column("text"))], []
            for q, x in zip(b.column("queue").to_pylist(), ids, strict=True):
                starts.append(so_far.get(q, 0))
                so_far[q] = starts[-1] + len(x) // 2
            wide = [np.frombuffer(x, dtype="<u2").astype("<u4").tobytes() for x in ids]
            columns = (pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(wide, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("queue"), *columns], names=["doc_id", "queue", "part", "local", "n", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = written(docs.select("doc_id", "text", queue.alias("queue")).mapInArrow(tokenize, f"doc_id {id_type}, queue string, part int, local long, n long, ids binary"), "ids")
    counted = rows.groupBy("queue", "part").agg(F.sum("n").alias("_n"))
    starts = written(counted.withColumns({"base": _running(["part"], "queue"), "total": F.sum("_n").over(Window.partitionBy("queue"))}).drop("_n"), "starts")
    queues = starts.groupBy("queue").agg(F.first("total").alias("total"))
    # Totals of the groups: each source with a target, and all others ("rest").
    group = F.when(F.col("queue").isin(list(named)), F.col("queue")).otherwise("rest")
    facts = queues.groupBy(group.alias("g")).agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("queues")).collect()
    totals = {r["g"]: r["n"] for r in facts}
    times, phases = schedule(totals, named | {"rest": 1 - sum(named.values()) if sum(named.values()) < 1 - 1e-9 else 0.0})
    schema = f"doc_id {id_type}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if not times:
        return docs.sparkSession.createDataFrame([], schema)
    rounds = Rounds(times, sum(totals.values()), sequence * max(window, sum(r["queues"] for r in facts)))
    mine = docs.sparkSession.createDataFrame([(g, totals[g], *phases[g]) for g in totals], "g string, whole long, counts array<double>, rates array<double>")
    grouped = lambda df: df.withColumn("g", group).join(F.broadcast(mine), "g").drop("g")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    begins = written(slices_of(grouped(queues), rounds), "slices")
    at = F.col("base") + F.col("local")
    placed = rows.join(small(grouped(starts)), ["queue", "part"]).withColumn("at", at)
    spread = placed.withColumn("window", F.explode(F.sequence(rounds.window(F.col("at")), rounds.window(F.col("at") + F.col("n") - 1))))
    cut = spread.withColumns({"low": F.greatest("at", rounds.served(F.col("window"))), "high": F.least(F.col("at") + F.col("n"), rounds.served(F.col("window") + 1))}).filter("low < high")
    piece = lambda begin, stop: F.substring("ids", (begin * 4 + 1).cast("int"), ((stop - begin) * 4).cast("int"))
    cut = cut.select("doc_id", "queue", "window", "n", "low", (F.col("low") - F.col("at")).alias("start"), (F.col("high") - F.col("low")).alias("length"), piece(F.col("low") - F.col("at"), F.col("high") - F.col("at")).alias("ids"))
    met = cut.join(small(begins), ["queue", "window"]).withColumn("place", F.col("position") + F.col("low") - F.col("first"))
    met = met.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"place div {sequence}"), F.expr(f"(place + length - 1) div {sequence}"))))
    begin = F.greatest(F.col("place"), F.col("sequence_id") * sequence)
    stop = F.least(F.col("place") + F.col("length"), (F.col("sequence_id") + 1) * sequence)
    last = met.select(
        "doc_id", (F.col("start") + begin - F.col("place")).alias("start"), (stop - begin).alias("length"), piece(begin - F.col("place"), stop - F.col("place")).alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id", (begin - F.col("sequence_id") * sequence).alias("offset"),
    )
    return last.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, null texts and sources included, at their natural shares.

    Very long texts are cut freely over sequences; repeated rows and ids are documents of their own. Inside a window sources stand by name. An empty table gives no
    piece. Other columns don't matter, whatever their names."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank file has the vocabulary of byte_bpe_50k.json; its special string is kept whole as `tokenizers` does."""
    return packing_stage(spark, documents(spark, sf_dir), sf_dir)
