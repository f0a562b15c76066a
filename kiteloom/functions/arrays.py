"""Functions of token arrays and vectors, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kiteloom.sources.shared import settled

#: The label of a token that isn't trained on (fixed value).
IGNORED = -100


def code_points(text: Column) -> Column:
    """A text's characters as numbers: a stand-in for a tokenizer."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)


def label_mask(prompt: Column, full: Column) -> Column:
    """The labels of a training example: prompt tokens ignored, the completion kept.

    An error is raised where the prompt isn't a proper beginning of the full sequence.
    """
    n = F.size(prompt)
    sound = (F.size(full) > n) & (F.slice(full, F.lit(1), n) == prompt)
    labels = F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(full, n + 1, F.greatest(F.size(full) - n, F.lit(0))))
    return F.when(sound, labels).otherwise(F.raise_error(F.lit("the prompt isn't a proper beginning of the full sequence")).cast("array<int>"))


def pad_right(a: Column, width: Column, value: int) -> Column:
    return F.concat(a, F.array_repeat(F.lit(value), width - F.size(a)))


def pad_left(a: Column, width: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value), width - F.size(a)), a)


def pad_batches(df: DataFrame, batch_col: str, pad_id: int = 0, side: str = "right", ids: str = "input_ids") -> DataFrame:
    """Pads token arrays to the longest of their batch: ids with ``pad_id``, labels with the ignored one, other integer arrays with 0.

    The width is aggregated by batch and joined back, so a large batch isn't gathered.
    """
    arrays = [f.name for f in df.schema if f.dataType.simpleString() in ("array<int>", "array<bigint>")]
    widths = df.groupBy(F.col(batch_col).alias("_batch")).agg(F.max(F.size(ids)).alias("_width"))
    pad = pad_right if side == "right" else pad_left
    fill = {ids: pad_id, "labels": IGNORED}
    rows = df.join(widths, F.col(batch_col).eqNullSafe(F.col("_batch")))
    return rows.select(*(pad(F.col(c), F.col("_width"), fill.get(c, 0)).alias(c) if c in arrays else F.col(c) for c in df.columns))


def supervised(labels: Column) -> Column:
    """How many labels are trained on."""
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def hit_limit(ids: Column, limit: int, pad_id: int = 0) -> Column:
    """Whether a generated sequence has ``limit`` or more tokens besides padding."""
    return F.size(F.filter(ids, lambda x: x != pad_id)) >= limit


def completion(prompt: Column, full: Column) -> Column:
    """What follows the prompt."""
    return F.slice(full, F.size(prompt) + 1, F.greatest(F.size(full) - F.size(prompt), F.lit(0)))


def squeeze(a: Column) -> Column:
    """The only row of a nested array; any other number of rows raises an error."""
    return F.when(F.size(a) == 1, a[0]).otherwise(F.raise_error(F.lit("one row is expected")).cast("array<int>"))


def same_sizes(*arrays: Column) -> Column:
    """Whether all arrays have one size."""
    out = F.lit(True)
    for a in arrays[1:]:
        out = out & (F.size(a) == F.size(arrays[0]))
    return out


def fit_reason(ids: Column, labels: Column, longest: int) -> Column:
    """Why an example is left out: too long, or nothing to learn; null if it is kept."""
    return F.when(F.size(ids) > longest, "sequence_too_long").when(supervised(labels) == 0, "no_supervised_tokens")


def norm(v: Column) -> Column:
    """Euclidean norm of a vector."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def product_norm(a: Column, b: Column, scale: Column) -> Column:
    """Frobenius norm of scale * B A, from the small products of both halves with themselves.

    A is rank rows of inputs, B outputs rows of rank; both are nested arrays. The
    trace of (A A') (B' B) never needs the full matrix.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    rank = F.size(a)
    column = lambda k: F.transform(b, lambda row: F.element_at(row, k))
    ranks = F.sequence(F.lit(1), rank)
    total = F.aggregate(
        F.flatten(F.transform(ranks, lambda i: F.transform(ranks, lambda j: dot(F.element_at(a, i), F.element_at(a, j)) * dot(column(i), column(j))))),
        F.lit(0.0),
        lambda s, z: s + z,
    )
    return scale * F.sqrt(F.greatest(total, F.lit(0.0)))


def numbered(df: DataFrame, *order: str, name: str = "position", buckets: int = 0) -> DataFrame:
    """Adds dense numbers from 1 in a total order, without one task for all rows.

    Rows are range-sorted into tasks, numbered within each, and offset by the sizes of the tasks before.
    """
    columns = [F.col(c) for c in order]
    ranged = df.repartitionByRange(buckets, *columns) if buckets else df.repartitionByRange(*columns)
    ranged = settled(ranged.withColumn("_task", F.spark_partition_id()), "ranges")  # task numbers must stay what they are
    sizes = ranged.groupBy("_task").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_task").alias("_of"), F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_task").orderBy(*columns))
    return ranged.withColumn("_within", within).join(before, F.col("_task") == F.col("_of")).withColumn(name, F.col("_within") + F.col("_before")).drop("_task", "_of", "_within", "_before")


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Adds batch, consecutive runs of ``size`` rows in a total order."""
    return numbered(df, *order).withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long"))


def cycled(step: Column, count: Column) -> Column:
    """The example, from 0, that a step takes when examples are gone through again and again."""
    return F.pmod(step, count)


def all_finite(x: Column) -> Column:
    """Whether an array has no NaN, no infinity and no null; true for an empty one, null for a null one."""
    return F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))


def any_nonzero(x: Column) -> Column:
    """Whether an array has a value other than 0, NaN and infinities included; nulls don't count, an empty one has none."""
    return F.exists(x, lambda v: F.coalesce(v != 0, F.lit(False)))
