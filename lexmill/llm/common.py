"""What the operators share: written tables, Arrow batches, words and single-evaluation bindings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and leaves all other bytes alone.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 256

_own_folder: list[str] = []
_written: list[tuple[str, DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets a temporary one, and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="lexmill-"))
        root = _own_folder[0]
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((path, spark.read.schema(df.schema).parquet(path)))
    return _written[-1][1]


def release(spark: SparkSession, df: DataFrame | None = None) -> None:
    """Delete what `written` has made in this process, once the results that read it have been stored; or df alone, which it returned, once nothing reads that."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for made in [x for x in _written if df is None or x[1] is df]:
        _written.remove(made)
        path = jvm.org.apache.hadoop.fs.Path(made[0])
        path.getFileSystem(conf).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value once: a lambda variable can't be inlined again into each use the way a projected column can."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few rows, so that Python objects exist for a small part of a batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns beside whole rows in `_doc`, so that an operator's results can't clash with a table's columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *columns)


def unboxed(df: DataFrame, docs: DataFrame, **replaced: Column) -> DataFrame:
    """The rows in `_doc` with docs' columns, some of them replaced."""
    return df.select(*[replaced.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
