"""Delimited files with line breaks inside quotes, each file read by many tasks.

Whether a line break ends a record depends on all quotes before it. Each line is
therefore looked at under both answers: does it end inside quotes if it starts
outside of them, and if it starts inside. A split's lines, taken together, are
again such a pair of answers, one row a split, and a running composition over
these rows tells every split how it begins. A second pass cuts records; only what
crosses the border of a split is gathered by record.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import settled

#: Splits up to this number, a row of few longs each, are broadcast to the second pass; more are joined by a shuffle of lines.
SPLITS = 1 << 20


def ends_inside(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes, if it starts at a record's start, and if it starts inside quotes.

    Doubled quotes go first. Then a quote at a field's start opens and the next
    one closes; others are text. After a closing quote, up to the separator,
    quotes are text too.
    """
    start = "(^\ufeff?|\\Q" + sep + "\\E)"
    single = F.replace(line, F.lit('""'), F.lit(""))
    left_open = lambda x: F.regexp_replace(x, start + '"[^"]*"', "$1\u0001").rlike(start + '"')
    plain = ~F.contains(line, F.lit('"'))
    rest = F.regexp_replace(single, '^[^"]*"', "\u0001")
    return F.when(plain, False).otherwise(left_open(single)), F.when(plain | ~F.contains(single, F.lit('"')), True).otherwise(left_open(rest))


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, start, value, out, in_): physical lines with the split they stand in, in order within it, and ``ends_inside``."""
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    out, in_ = ends_inside(F.col("value"), sep)
    return raw.select("file", "start", "value", out.alias("out"), in_.alias("in_"))


def _states(out: np.ndarray, in_: np.ndarray, entry: bool) -> tuple[np.ndarray, bool]:
    """Whether each line starts inside quotes, the first of them by ``entry``, and whether the last one ends so."""
    fixed, swaps = out == in_, np.cumsum(out & ~in_) & 1
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(out)), -1))
    after = np.where(last < 0, entry ^ swaps, out[last] ^ swaps ^ swaps[last]).astype(bool)
    return np.r_[entry, after[:-1]], bool(after[-1])


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where their first ``keys`` columns change, with these."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for i in range(keys):
            column = batch.column(i)
            change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield tuple(batch.column(i)[lo].as_py() for i in range(keys)), batch.slice(lo, hi - lo)


def _bools(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, start, out, in_, blank, cr) to one row a split: how it ends and how many records begin in it, for both ways it may start, and whether its first line ends in CR."""
    key, state, count, cr, rows = None, [False, True], [0, 0], False, []
    for own, run in _runs(batches, 2):
        if own != key:
            rows += [(*key, *state, *count, cr)] if key else []
            key, state, count, cr = own, [False, True], [0, 0], run.column(5)[0].as_py()
        out, in_, blank = (_bools(run.column(i)) for i in (2, 3, 4))
        for entry in (0, 1):
            before, state[entry] = _states(out, in_, state[entry])
            count[entry] += int((~before & ~blank).sum())
    rows += [(*key, *state, *count, cr)] if key else []
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "start", "out", "in_", "n_out", "n_in", "cr"])


def _placed(splits: DataFrame) -> DataFrame:
    """(file, start, of, inside, first, before, border, crlf): how each split begins, the number of its first record within the file, the file's number, and how many data records stand in files before.

    border says that the split starts or ends inside a record, crlf that the file's lines end in CRLF, as its first one does.

    Splits whose end doesn't hang on their start fix the state; others keep it or
    turn it round. So a state is the last fixed one, turned as often as splits
    after it do.
    """
    fixed, turn = F.col("out") == F.col("in_"), (F.col("out") & ~F.col("in_")).cast("int")
    of = W.partitionBy("file").orderBy("start")
    upto, earlier = of.rowsBetween(W.unboundedPreceding, 0), of.rowsBetween(W.unboundedPreceding, -1)
    turned = splits.withColumn("turns", F.sum(turn).over(upto)).withColumn("own", F.when(fixed, (F.col("out").cast("int") + F.col("turns")) % 2))
    state = F.coalesce(F.last("own", ignorenulls=True).over(earlier), F.lit(0)) + F.coalesce(F.lag("turns").over(of), F.lit(0))
    known = turned.withColumn("inside", state % 2 == 1)
    known = known.withColumn("n", F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")))
    known = known.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    files = known.groupBy("file").agg(F.greatest(F.sum("n") - 1, F.lit(0)).alias("data"), F.min_by("cr", "start").alias("crlf"))
    paths = W.orderBy("file")
    files = files.select("file", "crlf", F.row_number().over(paths).cast("long").alias("of"), F.coalesce(F.sum("data").over(paths.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    border = F.col("inside") | F.when(F.col("inside"), F.col("in_")).otherwise(F.col("out"))
    return known.withColumn("border", border).join(files, "file").select("file", "start", "of", "inside", "first", "before", "border", "crlf")


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (of, start, inside, first, value, out, in_) to (of, number, start, part, record); part says that the record goes on in another split."""
    key, state, number = None, False, 0
    held: list[str] = []  # the lines of a record that isn't complete, and whether it began in this split
    own = False
    rows: list[tuple] = []

    def flush(done: bool) -> None:
        nonlocal held, number
        if not held:
            return
        text, held = "\n".join(held), []
        if not own:
            rows.append((key[0], number - 1, key[1], True, text))
        elif not done or text not in ("", "\r"):
            rows.append((key[0], number, key[1], not done, text))
            number += 1

    def emitted() -> pa.RecordBatch:
        nonlocal rows
        kinds, given, rows = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in given], t) for i, t in enumerate(kinds)], names=["of", "number", "start", "part", "record"])

    for split, run in _runs(batches, 4):
        if split != key:
            flush(not state)
            key, state, number = split, split[2], split[3]
        out, in_ = _bools(run.column(5)), _bools(run.column(6))
        before, state = _states(out, in_, state)
        at = np.flatnonzero(~before)
        lines = run.column(4)
        head = int(at[0]) if len(at) else len(lines)
        if head:
            own = own if held else False
            held += lines[:head].to_pylist()
        if not len(at):
            continue
        flush(True)
        ends = np.r_[at[1:], len(lines)]
        whole = len(at) - 1  # the last one may go on
        texts = lines[head : int(at[-1])]
        if whole and len(texts) > whole:
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at[:-1], at[-1]] - head, pa.int32()), texts), "\n")
        if whole:
            full = ~pc.is_in(texts, pa.array(["", "\r"], texts.type)).to_numpy(zero_copy_only=False)
            texts, n = texts.filter(pa.array(full)), int(full.sum())
            if rows:
                yield emitted()
            same = lambda v: pa.array(np.full(n, v, np.int64))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(key[0]), pa.array(number + np.arange(n)), same(key[1]), pa.array(np.zeros(n, bool)), texts.cast(pa.string())], names=["of", "number", "start", "part", "record"])
            number += n
        held, own = lines[int(at[-1]) : int(ends[-1])].to_pylist(), True
    flush(not state)
    if rows:
        yield emitted()


def quoted_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(row, record) of all records but each file's first, the header; rows number on from 2 over files in the order of their paths.

    Records are whole texts, quotes included. Lines end in LF, or in CRLF if a
    file's first line does, and are then LF inside records too; lines without
    anything, outside of quotes, are no records. A quote that is never
    closed makes one record of the rest of its file. A task holds a batch of
    lines and one record; of a record over several splits each gives its part.
    """
    lines = _lines(spark, path, sep)
    looked_at = lines.select("file", "start", "out", "in_", F.col("value").isin("", "\r").alias("blank"), F.endswith("value", F.lit("\r")).alias("cr"))
    splits = settled(looked_at.mapInArrow(_summary, "file string, start long, out boolean, in_ boolean, n_out long, n_in long, cr boolean"), "splits")
    placed = settled(_placed(splits), "placed")
    few = placed.count() <= SPLITS

    def cut(some: DataFrame) -> DataFrame:
        if few:
            known = lines.join(F.broadcast(some), ["file", "start"])
        else:
            known = lines.withColumn("line", F.monotonically_increasing_id()).join(some.hint("merge"), ["file", "start"]).sortWithinPartitions("file", "start", "line")
        return known.select("of", "start", "inside", "first", "value", "out", "in_").mapInArrow(_records, "of long, number long, start long, part boolean, record string")

    every = cut(placed).where("NOT part").select("of", "number", "record")
    crossing = placed.where("border")
    if not crossing.isEmpty():
        parts = cut(crossing).where("part").groupBy("of", "number").agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"))
        every = every.union(parts.select("of", "number", F.array_join(F.col("parts.record"), "\n").alias("record")))
    files = placed.select("of", "before", "crlf").distinct()
    folded = F.when(F.col("crlf"), F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    every = every.where("number > 0").join(F.broadcast(files) if few else files, "of")
    return every.select((F.col("before") + F.col("number") + 1).alias("row"), folded.alias("record"))
