"""Helpers shared by the corpus operators: scratch tables, row identity and size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import re
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.scratch import folder

#: The blanks of the corpus contracts: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only when it is counted to have at most this many rows of a few longs.
BROADCAST_ROWS = 200_000
#: And at most this many bytes of texts.
BROADCAST_BYTES = 1 << 24


_OPEN: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """Collects the scratch tables that are written while it is open, by this thread, so that they can be deleted once a later
    table replaces them. Scopes nest: what an inner one has not deleted goes to the outer one when it closes."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scope:
        self.token = _OPEN.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _OPEN.reset(self.token)
        if (outer := _OPEN.get()) is not None:
            outer.paths += self.paths

    def delete(self, spark: SparkSession, but: tuple[DataFrame, ...] = ()) -> None:
        """Delete the tables, except those that ``but`` reads; only when nothing else unwritten reads them any more."""
        read = {place(f) for frame in but for f in frame.inputFiles()}
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            if place(path) not in read:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(hadoop).delete(where, True)
        self.paths = [x for x in self.paths if place(x) in read]


def place(path: str) -> str:
    """What tells a scratch table, or a file of it, from others: the name of its folder."""
    return re.search(r"/assay/([0-9a-f]{32})", path)[1] if "/assay/" in path else path


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back; a lost executor then costs no recomputation."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    if (scope := _OPEN.get()) is not None:
        scope.paths.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what training has freed to the system, where the C library keeps it otherwise: the driver lives on."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Number the rows. Only stable once written, so callers materialize the result before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a written table is counted to be small, in rows and in the bytes of its texts and lists, else leave the join
    to the planner."""
    some = df.limit(rows + 1)
    wide = [F.coalesce(F.sum(F.octet_length(c) if t in ("string", "binary") else 8 * F.size(c)), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary") or t.startswith("array")]
    n, *sizes = some.agg(F.count("*"), *wide).first()
    return F.broadcast(df) if n <= rows and sum(sizes) <= BROADCAST_BYTES else df


def least_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of a written table of distinct keys, least in hash order.

    A hash filter first leaves some four times as many as asked for, so that what tasks send on doesn't grow with their number."""
    n, space = df.count(), 1 << 30
    if n > 4 * rows:
        df = df.filter(F.pmod(F.xxhash64(F.lit("some"), key), F.lit(space)) < int(space * 4 * rows / n))
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def text_of(column: str | Column = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string")) % F.lit(folds)
