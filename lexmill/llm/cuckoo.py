"""Exact dedup by an index of cuckoo filters over the digests of live texts.

A text's digest is the SHA-256 of the text with every run of ASCII white space replaced by one space. Digests are dealt into buckets by their hash.
A bucket has a cuckoo filter, two bytes a digest, and its content: every live digest with its number of rows and the row that stays. Rows with a
digest that the filter doesn't hold are new; a hit is verified against the bucket's content, so that a false hit of the filter is a new text all the
same. When an insertion finds no place the filter doubles and is filled again from the stored content. Deletion takes rows out: the row that stays
is found again among those left, and a digest goes from filter and content with its last row.

Copies are combined in their task before the shuffle, so that a group of copies, however large, is one row a task in its bucket; the number of
buckets grows with the rows. A bucket is the unit of work, and all state is in written tables.

Null texts count as empty and are copies of each other. The row of smallest id stays, null ids last, of equal ids the first row. Repeated rows are
copies. Very long texts are hashed where they are and never moved. Empty tables give empty results; columns other than doc_id and text don't matter.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CLASS, documents, written

#: Marks in a cell, moves before an insertion gives up, cells of a new filter, share of a full filter's places that are planned for.
SLOTS, KICKS, CELLS, LOAD = 4, 200, 16, 0.9
#: Digests a bucket is planned for, and the least number of buckets.
PLANNED, BUCKETS = 1 << 16, 256
#: Digests that a task combines before it hands them on.
COMBINED = 100_000
#: Groups that are joined by a broadcast of 1 MB: the most frequent; any other has less than one row of so many.
FREQUENT = 10_000


class Filter:
    """A cuckoo filter of 16-bit marks. A digest's mark lies in one of two cells; either follows from the other and the mark."""

    def __init__(self, cells: int = CELLS, marks: bytes = b""):
        self.marks = array("H", marks or bytes(2 * SLOTS * cells))
        self.mask = len(self.marks) // SLOTS - 1

    def places(self, digest: bytes) -> tuple[int, int, int]:
        """The mark and its two cells."""
        mark, at = int.from_bytes(digest[8:10], "little") or 1, int.from_bytes(digest[:8], "little") & self.mask
        return mark, at, self.other(at, mark)

    def other(self, cell: int, mark: int) -> int:
        return cell ^ (mark * 0x5BD1E995 & self.mask)

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return mark in self.marks[a * SLOTS : a * SLOTS + SLOTS] or mark in self.marks[b * SLOTS : b * SLOTS + SLOTS]

    def swap(self, cell: int, old: int, new: int) -> bool:
        """Put `new` where the cell has `old`, if it has it."""
        for i in range(cell * SLOTS, cell * SLOTS + SLOTS):
            if self.marks[i] == old:
                self.marks[i] = new
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """Whether there was a place; if not, a mark is lost and the filter has to be filled again."""
        mark, a, b = self.places(digest)
        if self.swap(a, 0, mark) or self.swap(b, 0, mark):
            return True
        for kick in range(KICKS):
            i = b * SLOTS + kick % SLOTS
            mark, self.marks[i] = self.marks[i], mark
            b = self.other(b, mark)
            if self.swap(b, 0, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return self.swap(a, mark, 0) or self.swap(b, mark, 0)


class Bucket:
    """A filter and the content behind it: {digest: (rank of the row that stays, rows)}; a rank is (id is null, id, row)."""

    def __init__(self, content: dict[bytes, tuple[tuple, int]], marks: bytes = b""):
        self.content, self.filter = content, Filter(marks=marks)
        if not marks:
            self.fill(CELLS)

    def fill(self, cells: int) -> None:
        """Fill a filter of so many cells, or the next power of two that holds them, from the stored keys."""
        while cells * SLOTS * LOAD < len(self.content):
            cells *= 2
        while True:
            self.filter = Filter(cells)
            if all(map(self.filter.insert, self.content)):
                return
            cells *= 2

    def found(self, digest: bytes) -> tuple[tuple, int] | None:
        """The content of a live digest; only hits of the filter look there."""
        return self.content.get(digest) if digest in self.filter else None

    def add(self, digest: bytes, rank: tuple, n: int) -> None:
        known = self.found(digest)
        self.content[digest] = (rank, n) if known is None else (min(known[0], rank), known[1] + n)
        if known is None and not self.filter.insert(digest):
            self.fill(2 * (self.filter.mask + 1))

    def replace(self, digest: bytes, rank: tuple, n: int) -> None:
        """The digest has n rows from now on; with none it is deleted."""
        if self.found(digest) is None:
            return
        if n:
            self.content[digest] = (rank, n)
        else:
            del self.content[digest]
            self.filter.delete(digest)


def digests(docs: DataFrame, first: int = 0) -> DataFrame:
    """(doc_id, row, digest) of every row, written once: row numbers, from `first` on, hold from here on."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE_CLASS, " ")
    return written(docs.select("doc_id", (F.monotonically_increasing_id() + first).alias("row"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")


def _schema(rows: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), *more])


def _table(schema: T.StructType, columns: list[list]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)


def combined(rows: DataFrame) -> DataFrame:
    """(digest, doc_id, row, n): a task's rows of a digest as one, with the row of smallest rank."""
    schema = _schema(rows)

    def handed(seen: dict) -> pa.RecordBatch:
        return _table(schema, [list(seen), [r[1] for r, _ in seen.values()], [r[2] for r, _ in seen.values()], [n for _, n in seen.values()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            for i, row, d in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "digest")), strict=True):
                rank, old = (i is None, i, row), seen.get(d)
                seen[d] = (rank, 1) if old is None else (min(old[0], rank), old[1] + 1)
                if len(seen) >= COMBINED:
                    yield handed(seen)
                    seen = {}
        yield handed(seen)

    return rows.mapInArrow(run, schema)


class Index:
    """The live rows, the content of buckets and their filters, as written tables; every change gives a new index and leaves the old one as it was."""

    def __init__(self, rows: DataFrame, state: DataFrame, buckets: int):
        self.rows, self.state, self.buckets = rows, state, buckets

    @staticmethod
    def of(rows: DataFrame) -> Index:
        """An index of rows (doc_id, row, digest)."""
        spark = rows.sparkSession
        empty = spark.createDataFrame([], T.StructType([*_schema(rows), T.StructField("marks", T.BinaryType())]))
        return Index(rows.limit(0), empty, BUCKETS).insert(rows)

    def groups(self) -> DataFrame:
        """(digest, doc_id, row, n) of every live digest: the row that stays and the number of rows."""
        return self.state.filter("marks is null").drop("marks")

    def filters(self) -> DataFrame:
        return self.state.filter("marks is not null").select("marks")

    def _changed(self, rows: DataFrame, changes: DataFrame, how: str) -> Index:
        """The index after Bucket.`how` for each change (digest, doc_id, row, n)."""
        schema, buckets = self.state.schema, max(BUCKETS, 1 << max(0, rows.count() // PLANNED).bit_length())
        known = self.state if buckets == self.buckets else self.groups().withColumn("marks", F.lit(None).cast("binary"))  # filters are filled again from their keys
        at = F.when(F.col("marks").isNull(), F.pmod(F.xxhash64("digest"), F.lit(buckets))).otherwise(F.col("n"))  # a filter's row has its bucket as n

        def run(key, old: pa.Table, new: pa.Table) -> pa.Table:
            bucket = key[0].as_py()
            fields = lambda t: zip(*(t.column(c).to_pylist() for c in ("digest", "doc_id", "row", "n")), strict=True)
            marks = [m for m in old.column("marks").to_pylist() if m is not None]
            content = {d: ((i is None, i, row), n) for d, i, row, n in fields(old) if d is not None}
            b = Bucket(content, marks[0] if marks else b"")
            change = getattr(b, how)
            for d, i, row, n in fields(new):
                change(d, (i is None, i, row), n)
            live = b.content.items()
            columns = [[d for d, _ in live], [r[1] for _, (r, _) in live], [r[2] for _, (r, _) in live], [n for _, (_, n) in live], [None] * len(live)]
            for column, value in zip(columns, (None, None, None, bucket, b.filter.marks.tobytes()), strict=True):
                column.append(value)
            return pa.Table.from_batches([_table(schema, columns)])

        dealt = lambda df: df.withColumn("bucket", at.cast("int")).groupBy("bucket")
        both = dealt(known).cogroup(dealt(changes.withColumn("marks", F.lit(None).cast("binary"))))
        return Index(rows, written(both.applyInArrow(lambda key, old, new: run(key, old, new), schema), "cuckoo"), buckets)

    def insert(self, rows: DataFrame) -> Index:
        """The index with these rows (doc_id, row, digest) too; their numbers must differ from those it has."""
        return self._changed(self.rows.unionByName(rows), combined(rows), "add")

    def delete(self, rows: DataFrame) -> Index:
        """The index without the rows that have both an id and a digest of these (doc_id, digest)."""
        gone = rows.select("doc_id", "digest").distinct()
        same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])
        left = written(self.rows.join(gone, same(self.rows, gone), "left_anti"), "live")
        touched = gone.select("digest").distinct()
        rest = combined(left.join(touched, "digest", "left_semi").select("doc_id", "row", "digest"))
        rank = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i"), F.col("row").alias("r"))
        least = rest.groupBy("digest").agg(F.min(rank).alias("k"), F.sum("n").alias("n"))
        after = touched.join(least, "digest", "left").select("digest", F.col("k")["i"].alias("doc_id"), F.col("k")["r"].alias("row"), F.coalesce("n", F.lit(0)).alias("n"))
        return self._changed(left, after, "replace")

    def resolved(self) -> DataFrame:
        """Every live row with its group: doc_id, row, digest, keep_id, keep_row, n. Groups of one row need no join, the most frequent ones no shuffle."""
        named = self.groups().select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "n")
        several = written(named.filter("n > 1"), "repeated")
        hot = written(several.orderBy(F.desc("n"), "digest").limit(FREQUENT), "frequent")
        own = self.rows.join(F.broadcast(hot), "digest", "left")
        rest = own.filter("n is null").drop("keep_id", "keep_row", "n").join(several.join(F.broadcast(hot.select("digest")), "digest", "left_anti"), "digest", "left")
        single = rest.select("doc_id", "row", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_row", "row").alias("keep_row"), F.coalesce("n", F.lit(1)).alias("n"))
        return own.filter("n is not null").select(single.columns).union(single)


def op12_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    found = Index.of(digests(documents(spark, sf_dir))).resolved()
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
