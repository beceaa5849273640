"""The newest answer of each key, kept as state over a stream of answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.answers import CACHE, Cache

_COLUMNS = [f.split()[0] for f in CACHE.split(", ")]
_STATE = "created_at timestamp, answer string"


def newest(answers: DataFrame, keep: str = "1 day") -> DataFrame:
    """The rows of a stream of answers (CACHE's columns) that are newer than all of their key before; of equal times the smallest answer counts.

    Repeated events, and those that are older than what a key has, give no row. A key is forgotten when the stream's time is `keep` past its newest answer; what is
    older than that when it comes is late and dropped, so that state holds the keys of `keep` alone. Events without key or time are dropped. Files in any order give one result if none is late."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rank = lambda row: (-pd.Timestamp(row["created_at"]).value, row["answer"] is not None, row["answer"] or "")
        best, row = None, None
        if state.exists:
            time, answer = state.get
            best = rank({"created_at": time, "answer": answer})
        for frame in frames:
            for found in frame.to_dict("records"):
                if best is None or rank(found) < best:
                    best, row = rank(found), found
        if row is not None:
            time = pd.Timestamp(row["created_at"])
            state.update((time.to_pydatetime(), row["answer"]))
            state.setTimeoutTimestamp(max(int(time.value // 10**6), state.getCurrentWatermarkMs()) + 1)
            yield pd.DataFrame([row])[_COLUMNS]

    known = answers.select(*_COLUMNS).filter("query_hash is not null and created_at is not null").withWatermark("created_at", keep)
    return known.groupBy("query_hash").applyInPandasWithState(run, CACHE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def into_cache(answers: DataFrame, cache: Cache, checkpoint: str, keep: str = "1 day"):
    """A writer that keeps a stored cache at the newest answers; after a restart it goes on from its checkpoint, and a batch that is written again changes nothing."""
    return newest(answers, keep).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: cache.upsert(batch.select(*_COLUMNS).coalesce(1)))


def as_batch(answers: DataFrame) -> DataFrame:
    """What `newest` comes to, of a table of answers."""
    from ..operators.dedup import latest

    known = answers.select(*_COLUMNS).filter("query_hash is not null and created_at is not null")
    return latest(known, "query_hash", F.desc("created_at"), F.asc_nulls_first("answer"))
