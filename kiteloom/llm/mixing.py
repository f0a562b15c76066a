"""Mixing sources to target weights along a curriculum that changes over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, few, free_prefix, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: For each of these weights its course over training: (time, relative weight) knots, straight in between.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, rank, target) from the sources' sizes (source, source_size).

    Sources are ranked by code point, null last, and take the weights in turn.
    ``share`` of all sizes is dealt by weight; no target exceeds ``cap`` times
    its source, and what is over goes to the others by weight until none is
    above. That point is where every target is the lesser of its cap and one
    level times its weight: sources are capped in the order of size by weight,
    up to the first that the level of the rest doesn't fill. Runs over the table
    of sources alone.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    filled = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("source_size") * cap)
    whole = filled.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = levels.withColumn("first", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole))
    target = F.least(F.coalesce(F.col("first"), F.lit(float("inf"))) * F.col("weight"), F.col("source_size") * F.lit(float(cap)))
    return first.select("source", "source_size", "rank", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    """A schedule's straight pieces: start time, its weight, slope, and the share of the whole area reached at the start."""
    pieces = list(zip(knots, knots[1:]))
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pieces]
    whole, at, out = sum(areas), 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(pieces, areas):
        out.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in (("t", t0), ("w", w0), ("k", (w1 - w0) / (t1 - t0)), ("at", at), ("whole", whole)))))
        at += area
    return F.array(*out)


def time_at(part: Column, segments: Column) -> Column:
    """When a source has given ``part`` (0 to 1) of its tokens: its integrated schedule, inverted."""
    area = part * F.element_at(segments, 1)["whole"]
    s = F.element_at(F.filter(segments, lambda x: x["at"] <= area), -1)
    over = area - s["at"]
    return F.when(s["k"] == 0, s["t"] + over / s["w"]).otherwise(s["t"] + (-s["w"] + F.sqrt(F.greatest(s["w"] * s["w"] + s["k"] * 2 * over, F.lit(0.0)))) / s["k"])


def running_total(df: DataFrame, group: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one in its group.

    Rows are range-sorted by group and order into tasks of even size, whatever a
    group's size; each task sums its own run, and a table of one row for each
    group and task carries the sums on.
    """
    dealt = Table(df.repartitionByRange(F.col(group), *order).withColumn("task", F.spark_partition_id()), "ranges").df
    sums = dealt.groupBy(group, "task").agg(F.sum(value).alias("own"))
    before = F.coalesce(F.sum("own").over(W.partitionBy(group).orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select(F.col(group).alias("g"), F.col("task").alias("k"), before.alias("carried"))
    inside = W.partitionBy(group, "task").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = dealt.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(carried, F.col(group).eqNullSafe(F.col("g")) & (F.col("task") == F.col("k")))
    return joined.withColumn(name, F.col("inside") + F.col("carried")).drop("task", "k", "g", "inside", "carried", "own")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: int = 2,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """(id, hash, source, size, source_size, target, takes, positions): how much of each document the mix takes, and when.

    hash is the text's xxhash64, which tells rows with one id or none apart.

    A source's documents stand in the order of their ids' digests and pass up to
    ``cap`` times. Each pass takes whole documents until the source's target is
    reached; the one at the target is cut there, so a source's words come to its
    target, rounded. takes holds the words of each pass, positions the time (0
    to 1) of each take's middle under the source's schedule, null where nothing
    is taken. A null text has size 0; a null source is a source; null ids and
    repeated rows count as documents, and ties are equal rows; an empty table
    gives none; other columns are ignored. Only ids, sources and sizes are shuffled.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("hash"))
    own = Table(own.withColumn("digest", F.md5(F.col("id").cast("string").cast("binary"))), "sizes", narrow=True).df
    dealt = targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, float(cap))
    shaped = dealt.withColumn("segments", F.element_at(F.array(*(_segments(s) for s in schedules)), (F.col("rank") % len(schedules) + 1).cast("int")))
    placed = running_total(own, "source", ["digest", "id", "size", "hash"], "size", "before")
    shaped = shaped.withColumnRenamed("source", "of").withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    rows = placed.join(shaped, F.col("source").eqNullSafe(F.col("of")))
    start = lambda n: F.col("before") + F.col("source_size") * n
    takes = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda n: F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - start(n))).cast("long"))
    rows = rows.withColumn("takes", takes)
    positions = F.transform(F.col("takes"), lambda x, n: F.when(x > 0, time_at((start(n) + x / 2) / F.col("words"), F.col("segments"))))
    return rows.select(F.col("id").alias(id_col), "hash", F.col("source").alias(source_col), "size", "source_size", "target", "takes", positions.alias("positions"))


def taken(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document with the words taken in all passes, range-sorted by its first position, untaken ones last, ties by id.

    ``mixed`` is as ``mix`` gives it; null ids and repeated rows stay rows; no rows give none.
    """
    total = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = mixed.select(id_col, "size", "source_size", "target", total.alias("taken"), F.round(F.element_at("positions", 1), 9).alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), id_col)


def _first_words(text: Column, words: Column) -> Column:
    """A text's first words with what stands between and before them, natively: up to the end of the n-th word."""
    parts = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as the mix takes them, in training order: a row for each pass, texts cut where a target is reached.

    All columns are kept, whatever their names. Rows that repeat id and text are numbered, so each meets
    its own takes; no other text goes through that window. Texts without words, null ones among them, are never taken; a
    null id is met by its text; an empty table gives no rows.
    """
    names = "row of hash size take at own k n again again_hash".split()
    row, of, digest, size, take, at, own, k, n, again_of, again_digest = (f"{free_prefix(df, '_mix')}_{x}" for x in names)
    mixed = mix(df, id_col, text_col, source_col).withColumn(row, F.monotonically_increasing_id())
    each = F.explode(F.arrays_zip("takes", "positions")).alias("pass")
    passes = mixed.select(F.col(id_col).alias(of), F.col("hash").alias(digest), F.col("size").alias(size), row, each)
    passes = Table(passes.select(of, digest, size, row, F.col("pass.takes").alias(take), F.col("pass.positions").alias(at)), "passes", narrow=True).df
    rows = df.withColumn(own, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(of)) & (F.col(own) == F.col(digest))
    cut = F.when(F.col(take) < F.col(size), _first_words(F.col(text_col), F.col(take))).otherwise(F.col(text_col))
    out = lambda met: met.withColumn(text_col, cut).select(*df.columns, at)
    again = passes.groupBy(of, digest).agg(F.countDistinct(row).alias(n)).where(F.col(n) > 1).select(of, digest)
    again = Table(again, "again", narrow=True).df
    taken = passes.where(F.col(take) > 0)
    if again.isEmpty():
        return out(rows.join(few(taken), same)).orderBy(at, id_col).select(df.columns)
    pairs = again.select(F.col(of).alias(again_of), F.col(digest).alias(again_digest))
    repeated = F.col(of).eqNullSafe(F.col(again_of)) & (F.col(digest) == F.col(again_digest))
    once = Table(taken.join(pairs, repeated, "left_anti"), "once", narrow=True).df
    numbered = passes.join(pairs, repeated, "left_semi").withColumn(n, F.dense_rank().over(W.partitionBy(of, digest).orderBy(row)))
    repeats = rows.join(few(again), same, "left_semi").withColumn(k, F.row_number().over(W.partitionBy(id_col, own).orderBy(id_col)))
    more = repeats.join(numbered.where(F.col(take) > 0), same & (F.col(n) == F.col(k)))
    return out(rows.join(few(once), same)).union(out(more)).orderBy(at, id_col).select(df.columns)


TAKEN_SQL = """
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS digest,
         COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r),
l AS (SELECT *,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
            - COALESCE(sum(source_size) OVER f, 0)::DOUBLE * 2.0::DOUBLE)
         / (sum(weight) OVER () - COALESCE(sum(weight) OVER f, 0)) AS level
      FROM w WINDOW f AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT level FROM l WHERE level * weight <= source_size * 2.0::DOUBLE ORDER BY source_size / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank,
         CASE WHEN source_size = 0 THEN 0.0::DOUBLE
              ELSE least(COALESCE((SELECT level FROM v), 'inf'::DOUBLE) * weight, source_size * 2.0::DOUBLE) END AS target
      FROM w),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, floor(t.target + 0.5::DOUBLE)::BIGINT AS words,
         (COALESCE(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest NULLS FIRST, d.doc_id NULLS FIRST, d.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, words - before)) AS take1, greatest(0, least(size, words - before - source_size)) AS take2 FROM c),
p AS (SELECT *, (before + take1 / 2.0::DOUBLE) / words AS part FROM k)
SELECT doc_id, size, source_size, target, (take1 + take2)::BIGINT AS taken,
  CASE WHEN take1 > 0 THEN round(CASE rank % 3
    WHEN 0 THEN 0.0::DOUBLE + (-1.5::DOUBLE + sqrt(greatest(1.5::DOUBLE * 1.5::DOUBLE + -1.0::DOUBLE * 2 * part, 0.0::DOUBLE))) / -1.0::DOUBLE
    WHEN 1 THEN 0.0::DOUBLE + part / 1.0::DOUBLE
    ELSE 0.0::DOUBLE + (-0.5::DOUBLE + sqrt(greatest(0.5::DOUBLE * 0.5::DOUBLE + 1.0::DOUBLE * 2 * part, 0.0::DOUBLE))) / 1.0::DOUBLE
  END, 9) END AS position
FROM p
"""
