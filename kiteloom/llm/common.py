"""What the corpus operators share: written tables, table cuts and batch helpers."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written


class Table:
    """A written intermediate table: lineage ends here, and lost executors cost a re-read only.

    ``narrow`` says that rows are few bytes each, made by as many tasks as texts
    need: they are then merged to files of the advisory size before writing. The
    files are deleted by ``drop``, or when the driver ends.
    """

    def __init__(self, df: DataFrame, name: str, narrow: bool = False) -> None:
        df = df.hint("rebalance") if narrow else df
        self.spark = df.sparkSession
        self.path = written(df, name, compression="zstd")
        self.schema = self.spark.read.parquet(self.path).schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files. No frame that reads them may run afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Table(df, name).df


def few(keys: DataFrame, most: int = 1 << 20, most_bytes: int = 48 << 20) -> DataFrame:
    """A narrow table to join with texts: broadcast if it has at most ``most`` rows and ``most_bytes``, else joined by a shuffle.

    ``keys`` must be written, as its rows and the bytes of its values are counted first.
    """
    plain = lambda f: isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))
    varying = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in keys.schema.fields if not plain(f)]
    width = sum(varying, F.lit(8 * len(keys.columns)).cast("long"))
    rows, size = keys.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(keys) if rows <= most and size <= most_bytes else keys.hint("merge")


def free_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, with underscores before it until no column of ``df`` begins like that in any case: names made with it clash with none."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def kept_rows(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that the written ``found`` (id, hash, first, n) keeps: those with a null id, and one of the n equal rows that are a group's first.

    All columns are kept, whatever their names.
    """
    own, key, of = (free_prefix(df, "_kept") + x for x in ("_own", "_id", "_hash"))
    rows = df.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    named = lambda part, name: Table(part.select(F.col(id_col).alias(key), F.col("hash").alias(of)), name, narrow=True).df
    on = (F.col(id_col) == F.col(key)) & (F.col(own) == F.col(of))
    kept = rows.join(few(named(found.where("NOT first"), "copies")), on, "left_anti")
    again = named(found.where("first AND n > 1"), "again")
    if not again.isEmpty():
        kept = kept.join(few(again), on, "left_anti").union(kept.join(few(again), on, "left_semi").dropDuplicates([id_col, own]))
    return kept.select(df.columns)


def schema_of(df: DataFrame, id_col: str, fields: str) -> T.StructType:
    """A schema of the id column as ``df`` has it, then ``fields`` (DDL)."""
    return T.StructType([T.StructField(id_col, df.schema[id_col].dataType, True), *T.StructType.fromDDL(fields).fields])


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads; a null text counts as empty."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about ``max_bytes``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def whole_runs(batches: Iterable[pa.RecordBatch], least: int = 50_000) -> Iterator[list[pa.Array]]:
    """Columns of batches sorted by the first one, cut only where it changes."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        key = table.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield [c.chunk(0) for c in table.slice(0, last).combine_chunks().columns]
        kept, rows = table.slice(last).to_batches(), table.num_rows - last
    if rows:
        yield [c.chunk(0) for c in pa.Table.from_batches(kept).combine_chunks().columns]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2048) -> Iterator[None]:
    """What is run inside sends at most ``rows`` rows at once to Python: for rows of many bytes. The session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Gives a worker's unused memory back to the system: it lives on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def releasing(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, and ``release`` after it."""

    def done(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return done


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, without decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def hex64(column: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def word_count(text: Column) -> Column:
    """Words are runs of anything but space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
