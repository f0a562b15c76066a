"""Aggregates: numeric summaries, retention, rates, norms, parameter census, sampling and picks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiteloom.functions import arrays as A
from kiteloom.functions import text as X

from .quantiles import exact_quantiles


QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def numeric_summary(df: DataFrame, *columns: str, digits: int = 4, most: int = 1 << 20) -> DataFrame:
    """A row for each column: count, min, p25, median, mean, p75, p95, max, quantiles interpolated linearly.

    What isn't a number is left out; a column without numbers has count 0 and
    nulls. Quantiles are exact: of up to ``most`` rows in one aggregate, whose
    buffer holds all distinct values, of more by ``exact_quantiles``, in bounded
    memory and a few passes.
    """
    numbers = df.select(*(F.col(c).try_cast("double").alias(c) for c in columns))
    long = numbers.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns))).alias("r")).select("r.*")
    few = df.count() <= most
    q = F.percentile("x", F.array(*map(F.lit, QUANTILES.values()))) if few else F.lit(None).cast("array<double>")
    sums = long.groupBy("column").agg(F.count("x").alias("count"), F.min("x").alias("min"), q.alias("q"), F.avg("x").alias("mean"), F.max("x").alias("max"))
    if not few:
        found = exact_quantiles(numbers, columns, list(QUANTILES.values()))
        table = df.sparkSession.createDataFrame(list(found.items()), "column string, q array<double>")
        sums = sums.drop("q").join(F.broadcast(table), "column")
    rounded = lambda c: F.round(c, digits)
    return sums.select("column", "count", rounded("min").alias("min"), *(rounded(F.col("q")[i]).alias(k) for i, k in enumerate(QUANTILES)), rounded("mean").alias("mean"), rounded("max").alias("max"))


def retention(audited: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: raw rows and distinct ids and groups, kept rows, groups and equal sides, and the share kept."""
    raw = audited.agg(F.count("*").alias("raw_rows"), F.countDistinct("record_id").alias("unique_record_ids"), F.countDistinct("group_id").alias("unique_group_ids"))
    own = pairs.agg(F.count("*").alias("rows_kept"), F.countDistinct("group_id").alias("unique_groups_kept"), F.count_if(F.col("source") == F.col("target")).alias("identical_rows_kept"))
    both = raw.join(own, F.lit(True))  # one row each
    return both.withColumn("rows_dropped", F.col("raw_rows") - F.col("rows_kept")).withColumn("retention_fraction", F.round(F.col("rows_kept") / F.col("raw_rows"), 6))


def split_summary(rows: DataFrame) -> DataFrame:
    """(split, rows, groups, row_fraction) of split pairs."""
    each = rows.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("group_id").alias("groups"))
    total = rows.agg(F.count("*").alias("total"))
    return each.join(F.broadcast(total), F.lit(True)).select("split", "rows", "groups", F.round(F.col("rows") / F.col("total"), 6).alias("row_fraction"))


def rate(condition: Column, digits: int = 4) -> Column:
    """Share of rows for which a condition holds."""
    return F.round(F.avg(condition.cast("double")), digits)


def norms(df: DataFrame, group: str, norm: str, weights: str) -> DataFrame:
    """(group, norm, weights, rms_per_weight): the root of the sum of squares, the sum of weights, and their quotient."""
    return df.groupBy(group).agg(F.sqrt(F.sum(F.col(norm) * F.col(norm))).alias("norm"), F.sum(weights).alias("weights")).withColumn("rms_per_weight", F.col("norm") / F.sqrt(F.col("weights").cast("double")))


def global_norm(df: DataFrame, norm: str) -> DataFrame:
    return df.agg(F.count("*").alias("modules"), F.sqrt(F.sum(F.col(norm) * F.col(norm))).alias("total_norm"))


def adapter_norms(halves: DataFrame, rank: int, alpha: float, root_scaled: bool = False) -> DataFrame:
    """(path, module, norm, weights) of each adapted module from its halves (path, which, matrix)."""
    pairs = halves.groupBy("path").pivot("which", ["A", "B"]).agg(F.first("matrix"))
    scale = F.lit(alpha / (rank**0.5 if root_scaled else rank))
    return pairs.select("path", X.last_segment(F.col("path")).alias("module"), A.product_norm(F.col("A"), F.col("B"), scale).alias("norm"), (F.size("B") * F.size(F.element_at("A", 1))).alias("weights"))


def trained(halves: DataFrame) -> bool:
    """Whether any second half has a value other than zero; raises ``ValueError`` if there is none at all."""
    found = halves.where("which = 'B'").agg(F.count("*"), F.max(F.exists("matrix", lambda row: F.exists(row, lambda x: x != 0)))).first()
    if not found[0]:
        raise ValueError("the adapter has no second halves")
    return bool(found[1])


def parameter_census(df: DataFrame, name: str = "name", size: str = "numel", trainable: str = "trainable", allowed: Column | None = None, forbidden: Sequence[str] = ()) -> DataFrame:
    """One row: all and trainable parameters, the percentage, and the sorted names of trainable ones that shouldn't be."""
    bad = ~allowed if allowed is not None else F.lit(False)
    if forbidden:
        bad = bad | X.contains_any(F.col(name), F.array(*map(F.lit, forbidden)))
    sums = df.agg(
        F.sum(size).alias("total"),
        F.sum(F.when(F.col(trainable), F.col(size)).otherwise(0)).alias("trainable"),
        F.count_if(F.col(trainable)).alias("trainable_tensors"),
        F.sort_array(F.collect_set(F.when(F.col(trainable) & bad, F.col(name)))).alias("violations"),
    )
    return sums.withColumn("percentage", F.round(F.col("trainable") * 100.0 / F.col("total"), 4))


def target_modules(df: DataFrame, kinds: Sequence[str], excluded: Sequence[str], least: int = 8, name: str = "module", kind: str = "class") -> list[str]:
    """Sorted distinct names of modules of some kinds without excluded fragments; raises ``ValueError`` if they are fewer than ``least``."""
    rows = df.where(F.col(kind).isin(*kinds) & ~X.contains_any(F.col(name), F.array(*map(F.lit, excluded)))) if excluded else df.where(F.col(kind).isin(*kinds))
    found = [r[0] for r in rows.select(name).distinct().orderBy(name).collect()]
    if len(found) < least:
        raise ValueError(f"{least} modules are expected at least, found {found}")
    return found


def reason_histogram(df: DataFrame, reason: Column) -> DataFrame:
    """(reason, rows) of examples that are left out."""
    return df.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("rows"))


def hash_order(key: Column, seed: int) -> Column:
    """A shuffle's order: the digest of seed and key, the same on every machine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def sample(df: DataFrame, size: int, seed: int, key: str = "record_id", rng: str = "hash") -> DataFrame:
    """``size`` rows (or all) with ``sample_pos`` from 1, their order in the sample.

    ``rng="hash"`` takes the first of the hash order; each task keeps as many, no
    more. ``"reference"`` draws on the driver as pandas does: for small tables
    whose keys in a given order may be collected.
    """
    if rng == "hash":
        ordered = df.withColumn("_h", hash_order(F.col(key), seed)).orderBy("_h", key).limit(size)
    elif rng == "reference":
        import pandas as pd

        order = [c for c in ("raw_row_number", key) if c in df.columns][:1]
        keys = pd.Series([r[0] for r in df.select(key).orderBy(*order).collect()], dtype=object)
        drawn = keys.sample(n=min(size, len(keys)), random_state=seed)
        table = df.sparkSession.createDataFrame(list(enumerate(drawn, 1)), f"sample_pos int, _k {df.schema[key].dataType.simpleString()}")
        return df.join(F.broadcast(table), F.col(key) == F.col("_k")).drop("_k")
    else:
        raise ValueError(f"unknown rng: {rng}")
    from pyspark.sql import Window as W

    return ordered.withColumn("sample_pos", F.row_number().over(W.orderBy("_h", key))).drop("_h")  # size rows at most


def shuffled(df: DataFrame, seed: int, key: str = "record_id") -> DataFrame:
    """All rows in hash order, range-sorted."""
    return df.orderBy(hash_order(F.col(key), seed), key)


def first_fitting(df: DataFrame, reason: Column, count: int, seed: int, key: str = "record_id") -> DataFrame:
    """The first ``count`` rows of the hash order that have no reason to be left out."""
    return df.where(reason.isNull()).orderBy(hash_order(F.col(key), seed), key).limit(count)


def extremes(df: DataFrame, value: str, key: str, count: int = 20, highest: bool = True) -> DataFrame:
    """The rows with the highest or lowest values, ties by key."""
    return df.orderBy(F.desc(value) if highest else F.asc(value), key).limit(count)


def browsed(df: DataFrame, base: str, system: str, key: str, mode: str = "gain", search: str = "", within: Sequence[str] = (), count: int = 50) -> DataFrame:
    """The sentences a reader looks through: those in which one of the columns ``within`` has ``search`` in either case, sorted by ``mode``.

    gain: the largest gain of ``system`` over ``base`` first; high and low: by the
    score of ``system``. Ties by key, nulls last; ``count`` rows are returned.
    """
    modes = {"gain": F.col(system) - F.col(base), "high": F.col(system), "low": -F.col(system)}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}; modes are {sorted(modes)}")
    if search:
        df = df.where(reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(search.lower())) for c in within), F.lit(False)))
    return df.orderBy(modes[mode].desc_nulls_last(), key).limit(count)


def every(df: DataFrame, step: int, *order: str) -> DataFrame:
    """Every ``step``-th row of a total order, from the first."""
    return A.numbered(df, *order).where((F.col("position") - 1) % step == 0)


def representative(df: DataFrame, gain: str, score: str, key: str, count: int) -> DataFrame:
    """(key, pick): the largest gains, then the lowest score and the middle one, ``count`` rows in all.

    The middle row is found by its place among the scores, counted in ranges;
    a table of ``count`` rows or fewer is returned whole.
    """
    total = df.count()
    if count >= total:
        return df.select(key, F.lit("gain").alias("pick"))
    ranks = A.numbered(df.select(key, score), score, key).where(F.col("position").isin(1, total // 2 + 1))
    fixed = ranks.select(key, F.when(F.col("position") == 1, "hardest").otherwise("typical").alias("pick"))
    gains = df.join(F.broadcast(fixed.select(key)), key, "left_anti").orderBy(F.desc(gain), key).limit(max(count - 2, 0))
    return gains.select(key, F.lit("gain").alias("pick")).union(fixed.orderBy("pick").limit(min(2, count)))


def profile_predictions(df: DataFrame) -> DataFrame:
    """One row about (record_id, source, target, prediction, hit_token_limit): sizes, copies, matches, script, and the ratio of summed lengths."""
    own, ref, src = (X.metric_text(F.col(c)) for c in ("prediction", "target", "source"))
    limit = F.coalesce(F.col("hit_token_limit"), F.lit(False))
    return df.agg(
        F.count("*").alias("rows"),
        F.countDistinct("record_id").alias("unique_ids"),
        (F.count("*") - F.countDistinct("record_id")).alias("duplicate_ids"),
        F.count_if(own == "").alias("empty"),
        F.count_if(own == src).alias("copies"),
        F.count_if(own == ref).alias("matches"),
        F.count_if(limit).alias("limit_hits"),
        F.round(F.avg(X.script_ratio(X.text_of(F.col("prediction")))), 6).alias("mean_script_ratio"),
        F.round(F.sum(F.length(X.text_of(F.col("prediction")))) / F.sum(F.length(X.text_of(F.col("target")))), 6).alias("length_ratio"),
    )


def differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left, right) where two maps differ, keys of either only included."""
    a, b = left.select(F.col(key).alias("ka"), F.col(value).alias("left")), right.select(F.col(key).alias("kb"), F.col(value).alias("right"))
    joined = a.join(b, F.col("ka") == F.col("kb"), "full")
    return joined.where(~F.col("left").eqNullSafe(F.col("right")) | F.col("ka").isNull() | F.col("kb").isNull()).select(F.coalesce("ka", "kb").alias(key), "left", "right")
