"""Byte-level BPE encoding and decoding.

Encoding folds ranked merges over the bytes of each distinct word. `encode` does so in Arrow batches, where a worker
remembers the words it has met; `encode_words` is the same fold in Spark's higher-order functions over a table of
distinct words with a literal rank map (see the README for why the query takes the first). Decoding concatenates the
binary pieces of the ids from a literal array, in higher-order functions.

Null and empty texts give no ids and decode to no bytes. Other columns pass through, but one named as the result is
replaced. Empty tables give empty results, repeated rows equal ones; very long texts are encoded whole, a word of n bytes in n log n steps.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, documents, let, slices
from .tokens import Encoder, merge, read_ranks


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the array of ids of each text, without special tokens."""
    schema = T.StructType([f for f in df.schema.fields if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    keep = [f.name for f in schema.fields[:-1]]
    kind = pa.list_(pa.field("element", pa.int32(), nullable=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        encode = Encoder(lambda word: array("i", merge(word.encode(), ranks)).tobytes())
        for b in slices(batches):
            coded = [encode(x) for x in as_text(b.column(text))]
            ends = np.cumsum([0, *map(len, coded)], dtype=np.int64) // 4
            values = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], names=[*keep, ids])

    return df.mapInArrow(run, schema)


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids: pieces by a literal array, concatenated (as hexadecimal digits, joined in linear time)."""
    ranks = read_ranks(path)
    digits = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        digits[rank] = token.hex()
    literal = F.split(F.lit(",".join(digits)), ",")
    return let(literal, lambda p: F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(p, i + 1)), "")))


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word", ids: str = "ids") -> DataFrame:
    """The fold in higher-order functions, for a table of distinct words.

    Parts are strings of hexadecimal digits. The literal rank map is an array of maps, dealt by crc32, so that a lookup
    searches a few entries. A word of n bytes takes n - 1 steps at most; each merges the leftmost pair of lowest rank.
    """
    buckets = 1 << 14
    import json
    import zlib

    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        table[zlib.crc32(token.hex().encode()) % buckets][token.hex()] = rank
    literal = F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")
    none = F.lit(1 << 30)

    def rank(maps: Column, part: Column) -> Column:
        return F.coalesce(F.try_element_at(F.element_at(maps, (F.crc32(part.cast("binary")) % buckets + 1).cast("int")), part), none)

    def fold(maps: Column) -> Column:
        def step(parts: Column, _: Column) -> Column:
            ranked = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(rank(maps, F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))).alias("r"), i.alias("i")))

            def merged(low: Column) -> Column:
                both = F.concat(F.element_at(parts, low["i"]), F.element_at(parts, low["i"] + 1))
                return F.when(low["r"] == none, parts).otherwise(
                    F.concat(F.slice(parts, F.lit(1), low["i"] - 1), F.array(both), F.slice(parts, low["i"] + 2, F.size(parts)))
                )

            return F.when(F.size(parts) < 2, parts).otherwise(let(F.array_min(ranked), merged))

        digits = F.hex(F.col(word).cast("binary"))
        parts = F.filter(F.transform(F.split(F.lower(digits), "(?<=\\G..)"), lambda x: x), lambda x: x != "")
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(word) - 1))
        return F.transform(F.aggregate(steps, parts, step), lambda p: rank(maps, p))

    return words.withColumn(ids, let(literal, fold))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(documents(spark, sf_dir).select("doc_id", "text"), path).select("doc_id", "ids")
    ids = F.col("ids")
    return coded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(ids, path), 256).alias("decoded_sha256"),
    )
