"""Training histories: series of numbers by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entries(history: DataFrame, value: str) -> DataFrame:
    """(step, value) of the entries that have the value."""
    return history.where(F.col(value).isNotNull()).select("step", F.col(value).alias("value"))


def trailing_mean(train: DataFrame, at: DataFrame, width: int = 50, key: str = "step") -> DataFrame:
    """(key, n, mean): for each point of ``at``, over the values of ``train`` with ``key`` in (point - width, point].

    A range join by blocks of ``width``: a window reaches into two blocks, each of
    which meets its values, summed by key, in an equi-join; no task holds the
    whole series.
    """
    block = lambda c: F.floor(c / width)
    values = train.groupBy(key).agg(F.sum("value").alias("s"), F.count("value").alias("n")).withColumn("b", block(F.col(key)))
    points = at.select(F.col(key).alias("point")).distinct().withColumn("b", F.explode(F.array(block(F.col("point")), block(F.col("point")) - 1)))
    near = points.join(values, "b", "left")
    inside = (F.col(key) > F.col("point") - width) & (F.col(key) <= F.col("point"))
    sums = near.groupBy("point").agg(F.sum(F.when(inside, F.col("s"))).alias("s"), F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).cast("long").alias("n"))
    return sums.select(F.col("point").alias(key), "n", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean"))


def running_best(history: DataFrame, key: str = "step", blocks: int = 1000) -> DataFrame:
    """(step, value, best_before, improved): whether each value is less than all before it.

    Minima are first taken by block of steps and carried on over the table of
    blocks, then within each block. ``key`` must be unique.
    """
    values = history.withColumn("b", F.floor(F.col(key) / blocks))
    carried = values.groupBy("b").agg(F.min("value").alias("least"))
    carried = carried.select("b", F.min("least").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    own = F.min("value").over(W.partitionBy("b").orderBy(key).rowsBetween(W.unboundedPreceding, -1))
    out = values.join(carried, "b").withColumn("best_before", F.least(own, "carried"))
    return out.select(key, "value", "best_before", (F.col("best_before").isNull() | (F.col("value") < F.col("best_before"))).alias("improved"))


def best(history: DataFrame, key: str = "step") -> DataFrame:
    """(step, value) of the least value, the earliest on ties."""
    return history.agg(F.min(F.struct("value", key)).alias("m")).select(F.col(f"m.{key}").alias(key), "m.value")


def latest(history: DataFrame, value: str, key: str = "step") -> DataFrame:
    """(step, value) of the last entry that has the value."""
    return history.where(F.col(value).isNotNull()).agg(F.max(F.struct(key, value)).alias("m")).select(f"m.{key}", F.col(f"m.{value}").alias(value))


def bounds(history: DataFrame, value: str = "value", key: str = "step") -> DataFrame:
    """One row: the chart's limits, and the first and last value."""
    return history.agg(F.min(key).alias("x_min"), F.max(key).alias("x_max"), F.min(value).alias("y_min"), F.max(value).alias("y_max"), F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last"))


def accumulated(losses: DataFrame, size: int, index: str = "i", value: str = "loss") -> DataFrame:
    """(step, mean): micro-batch losses averaged by optimizer step of ``size``, from 1."""
    return losses.groupBy((F.floor(F.col(index) / size) + 1).cast("long").alias("step")).agg(F.avg(value).alias("mean"))


def newest_complete(files: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(newest, incomplete) from (dir, file, size): the highest complete checkpoint's step, and the newer ones that aren't."""
    step = F.regexp_extract("dir", "checkpoint-(\\d+)$", 1)
    good = F.collect_set(F.when((F.col("size") > 0) & F.col("file").isin(*required), F.col("file")))
    dirs = files.where(F.col("dir").rlike("checkpoint-\\d+$")).groupBy(step.cast("long").alias("step")).agg((F.size(good) == len(required)).alias("complete"))
    newest = dirs.agg(F.max(F.when(F.col("complete"), F.col("step"))).alias("newest"))
    return dirs.join(F.broadcast(newest), F.lit(True)).groupBy("newest").agg(F.sort_array(F.collect_list(F.when(~F.col("complete") & (F.col("newest").isNull() | (F.col("step") > F.col("newest"))), F.col("step"))), asc=False).alias("incomplete"))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """(rate, minutes_left) of a job."""
    speed = done / seconds
    return F.struct(speed.alias("rate"), ((total - done) / speed / 60).alias("minutes_left"))


def warmup_steps(ratio: float, steps: int) -> int:
    from math import ceil

    return ceil(ratio * steps)
