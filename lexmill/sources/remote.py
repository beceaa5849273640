"""Embeddings and answers from a service, given as a callable that executors can pickle."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH, RETRIES, LONGEST_WAIT = 16, 5, 30.0
PASSING = (ConnectionError, TimeoutError)


def patient(call: Callable, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> Callable:
    """call, again after connection errors and timeouts, with waits that double up to LONGEST_WAIT."""

    def run(x):
        for attempt in range(retries + 1):
            try:
                return call(x)
            except PASSING:
                if attempt == retries:
                    raise
                wait(min(LONGEST_WAIT, 2.0**attempt))

    return run


def _extended(df: DataFrame, *fields: T.StructField) -> tuple[list[str], T.StructType]:
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in fields}]
    return [f.name for f in kept], T.StructType([*kept, *fields])


def embed(df: DataFrame, call: Callable[[list[str]], list[tuple[int, list[float]]]], text: str = "text", name: str = "embedding", batch: int = BATCH) -> DataFrame:
    """Adds each text's vector. The service gets up to `batch` texts and may answer in any order, each vector with its index."""
    keep, schema = _extended(df, T.StructField(name, T.ArrayType(T.FloatType())))
    ask, size = patient(call), max(1, batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, vectors = [x or "" for x in b.column(text).to_pylist()], []
            for at in range(0, len(texts), size):
                vectors += [v for _, v in sorted(ask(texts[at : at + size]), key=lambda x: x[0])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(vectors, pa.list_(pa.float32()))], names=[*keep, name])

    return df.mapInArrow(run, schema)


def generate(df: DataFrame, call: Callable[[str], tuple[str, str | None]], prompt: str = "prompt") -> DataFrame:
    """Adds answer and finish_reason of each prompt; a blank answer is an error. Put filters before it: it is the costly step."""
    keep, schema = _extended(df, T.StructField("answer", T.StringType()), T.StructField("finish_reason", T.StringType()))
    ask = patient(call)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [ask(x) for x in b.column(prompt).to_pylist()]
            if any(not (a or "").strip() for a, _ in made):
                raise RuntimeError("the service gave a blank answer")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([a for a, _ in made], pa.string()), pa.array([r for _, r in made], pa.string())], names=[*keep, "answer", "finish_reason"])

    return df.mapInArrow(run, schema)
