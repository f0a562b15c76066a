"""Comparing translation systems: alignment, scores, significance, length buckets, deltas.

Predictions stay in long form, one row for each record and system:
(record_id, system, source, target, prediction). Statistics are counted once a
row; every score after that is a sum and a formula.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiteloom.functions import metrics as M
from kiteloom.functions import text as X
from kiteloom.functions.arrays import numbered

from .resample import replicate_sums

COPY = "copy_source"


def with_copy_system(rows: DataFrame, name: str = COPY) -> DataFrame:
    """Adds the system that returns its source; each record once."""
    least = F.min(F.struct("source", "target")).alias("s")
    once = rows.groupBy("record_id").agg(least).select("record_id", "s.*")
    return rows.unionByName(once.withColumn("system", F.lit(name)).withColumn("prediction", F.col("source")), allowMissingColumns=True)


def missing_predictions(sample: DataFrame, predictions: DataFrame) -> DataFrame:
    """(system, missing): how many records of the sample each system lacks; membership, not numbers, counts."""
    ids = sample.select("record_id").distinct()
    have = predictions.join(ids, "record_id", "left_semi").groupBy("system").agg(F.countDistinct("record_id").alias("have"))
    systems = predictions.select("system").distinct()
    total = ids.agg(F.count("*").alias("total"))
    return systems.join(have, "system", "left").join(F.broadcast(total), F.lit(True)).select("system", (F.col("total") - F.coalesce("have", F.lit(0))).alias("missing"))


def require_complete(sample: DataFrame, predictions: DataFrame, allow_partial: bool = False) -> list[str]:
    """Names of incomplete systems; raises ``ValueError`` if there are any and they aren't allowed."""
    found = [r[0] for r in missing_predictions(sample, predictions).where("missing > 0").orderBy("system").collect()]
    if found and not allow_partial:
        raise ValueError(f"incomplete systems: {found}")
    return found


def common(predictions: DataFrame) -> DataFrame:
    """The rows of records that every system has."""
    total = predictions.agg(F.countDistinct("system").alias("systems"))
    have = predictions.groupBy("record_id").agg(F.countDistinct("system").alias("n"))
    ids = have.join(F.broadcast(total), F.col("n") == F.col("systems")).select("record_id")
    return predictions.join(ids, "record_id", "left_semi")


def aligned(sample: DataFrame, predictions: DataFrame) -> DataFrame:
    """Sample and predictions joined, records that every system has, in long form with ``sample_pos``."""
    rows = predictions.join(sample.select("record_id", "source", "target", "sample_pos"), "record_id")
    return common(rows)


def remaining(sample: DataFrame, done: DataFrame, key: str = "record_id") -> DataFrame:
    """The rows of the sample that aren't done."""
    return sample.join(done.select(key).distinct(), key, "left_anti")


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out evenly: adaptive execution joins them to few tasks by their bytes, while counting n-grams takes about a millisecond a row."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def scored(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(record_id, system, chrf, bleu, own columns): statistics of each row, with what rates need."""
    p, t, s = (X.metric_text(F.col(c)) for c in ("prediction", "target", "source"))
    clean = spread(rows).select("record_id", "system", *keep, p.alias("p"), t.alias("t"), s.alias("s"))
    return clean.select(
        "record_id",
        "system",
        *keep,
        M.chrf_stats("p", "t").alias("chrf"),
        M.chrf_stats("p", "s").alias("chrf_source"),
        M.bleu_stats("p", "t").alias("bleu"),
        (F.col("p") == F.col("s")).alias("copied"),
        (F.col("p") == F.col("t")).alias("matched"),
        (F.col("p") == "").alias("empty"),
    )


def corpus_scores(stats: DataFrame, *by: str) -> DataFrame:
    """A row for each group: sentences, chrF++, BLEU, chrF++ against the source, and rates; nothing for no rows."""
    sums = stats.groupBy(*by).agg(
        F.count("*").alias("sentences"),
        M.summed(F.col("chrf"), M.CHRF_COUNT).alias("a"),
        M.summed(F.col("chrf_source"), M.CHRF_COUNT).alias("b"),
        M.summed(F.col("bleu"), M.BLEU_COUNT).alias("c"),
        *(F.round(F.avg(F.col(c).cast("double")), 4).alias(name) for c, name in (("copied", "exact_copy_rate"), ("matched", "exact_match_rate"), ("empty", "empty_rate"))),
    )
    rounded = lambda score, name: F.round(score, 4).alias(name)
    return sums.select(*by, "sentences", rounded(M.chrf_score(F.col("a")), "chrfpp"), rounded(M.bleu_score(F.col("c")), "bleu"), rounded(M.chrf_score(F.col("b")), "chrfpp_vs_source"), "exact_copy_rate", "exact_match_rate", "empty_rate")


def sentence_scores(stats: DataFrame, *keep: str) -> DataFrame:
    return stats.select("record_id", "system", *keep, F.round(M.chrf_score(F.col("chrf")), 4).alias("chrfpp"))


def by_length(stats: DataFrame) -> DataFrame:
    """(length_bucket, system, sentences, chrfpp) from statistics that keep ``source_words``."""
    rows = stats.withColumn("length_bucket", X.length_bucket(F.col("source_words")))
    sums = rows.groupBy("length_bucket", "system").agg(F.count("*").alias("sentences"), M.summed(F.col("chrf"), M.CHRF_COUNT).alias("a"))
    return sums.select("length_bucket", "system", "sentences", F.round(M.chrf_score(F.col("a")), 4).alias("chrfpp"))


def exact_mean(score: str, digits: int = 4) -> Column:
    """Mean of scores that have ``digits`` decimals, to as many: summed as whole numbers, so ties round alike in any order of rows."""
    unit = 10**digits
    return F.round(F.sum(F.round(F.col(score) * unit).cast("long")) / F.count(score)) / unit


def bands(sentences: DataFrame, low: float = 30.0, high: float = 80.0) -> DataFrame:
    """(system, below, from_high, mean): how many sentences score under ``low`` and at ``high`` or above."""
    return sentences.groupBy("system").agg(F.count_if(F.col("chrfpp") < low).alias("below"), F.count_if(F.col("chrfpp") >= high).alias("from_high"), exact_mean("chrfpp").alias("mean"))


def cohorts(sentences: DataFrame, longer: float = 1.5) -> DataFrame:
    """(cohort, system, sentences, mean): references at least ``longer`` times their source in characters, and the others."""
    name = F.when(F.length("target") >= F.length("source") * longer, "longer_reference").otherwise("similar_length")
    return sentences.groupBy(name.alias("cohort"), "system").agg(F.count("*").alias("sentences"), exact_mean("chrfpp").alias("mean"))


def deltas(sentences: DataFrame, base: str, system: str) -> DataFrame:
    """(record_id, base, system, delta) of two systems' rounded sentence scores."""
    at = lambda name: F.max(F.when(F.col("system") == name, F.col("chrfpp")))
    both = sentences.where(F.col("system").isin(base, system)).groupBy("record_id").agg(at(base).alias("chrfpp_base"), at(system).alias("chrfpp_system"))
    return both.where("chrfpp_base IS NOT NULL AND chrfpp_system IS NOT NULL").withColumn("delta", F.round(F.col("chrfpp_system") - F.col("chrfpp_base"), 4))


def wide(rows: DataFrame, sentences: DataFrame, systems: Sequence[str]) -> DataFrame:
    """One row for each record with a prediction and a score for each system, for the result file."""
    joined = rows.join(sentences.select("record_id", "system", "chrfpp"), ["record_id", "system"])
    at = lambda c, name: F.max(F.when(F.col("system") == name, F.col(c)))
    columns = [x for name in systems for x in (at("prediction", name).alias(f"prediction_{name}"), at("chrfpp", name).alias(f"chrfpp_{name}"))]
    limits = [at("hit_token_limit", name).alias(f"hit_token_limit_{name}") for name in systems if name != COPY] if "hit_token_limit" in rows.columns else []
    first = [F.min(c).alias(c) for c in ("sample_pos", "source", "target") if c in rows.columns]
    return joined.groupBy("record_id").agg(*first, *columns, *limits)


def comparisons(systems: Sequence[str], base: str = "base", primary: str = "tuned") -> list[tuple[str, str]]:
    """(baseline, candidate): every system against the base, the primary one against all other systems."""
    others = [s for s in systems if s not in (base, COPY)]
    out = [(base, s) for s in others] if base in systems else []
    return out + ([(s, primary) for s in others if s != primary] if primary in systems else [])


def _placed(stats: DataFrame, base: str, system: str) -> DataFrame:
    """(place, x, y): the statistics of baseline and candidate of each record that has both, numbered from 0 by record."""
    both = stats.where(F.col("system").isin(base, system)).groupBy("record_id").agg(
        F.max(F.when(F.col("system") == base, F.col("chrf"))).alias("x"), F.max(F.when(F.col("system") == system, F.col("chrf"))).alias("y")
    )
    return numbered(both.where("x IS NOT NULL AND y IS NOT NULL"), "record_id").select((F.col("position") - 1).cast("long").alias("place"), "x", "y")


def _deltas_of(sums: DataFrame) -> DataFrame:
    return sums.select("replicate", (M.chrf_score(F.col("y")) - M.chrf_score(F.col("x"))).alias("delta"))


def bootstrap_replicates(stats: DataFrame, base: str, system: str, samples: int, seed: int, small: int = 1 << 16) -> DataFrame:
    """(replicate, delta): chrF++ of the candidate less the baseline's over draws with replacement, the same for both.

    Draw i of replicate b takes the record at a place given by the digest of seed,
    b and i. Draws are counted by replicate and place before any statistics are
    met, so that what joins is at most records times replicates small rows, and
    sums are combined in each task. Statistics, some 400 bytes a
    record, are broadcast up to ``small`` rows. ``tree_replicates`` makes no row
    for a draw and is the form for many records.
    """
    placed = _placed(stats, base, system)
    count = placed.count()
    spark = stats.sparkSession
    if not samples or not count:
        return spark.createDataFrame([], "replicate long, delta double")
    draws = spark.range(samples * count).select(F.floor(F.col("id") / count).alias("replicate"), (F.col("id") % count).alias("i"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("i").cast("string")).cast("binary"))
    place = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(count))
    weights = draws.select("replicate", place.alias("place")).groupBy("replicate", "place").agg(F.count("*").alias("w"))
    met = weights.join(F.broadcast(placed) if count <= small else placed, "place")
    weighed = lambda c: F.array(*(F.sum(F.col(c)[i] * F.col("w")) for i in range(M.CHRF_COUNT)))
    return _deltas_of(met.groupBy("replicate").agg(weighed("x").alias("x"), weighed("y").alias("y")))


def tree_replicates(stats: DataFrame, base: str, system: str, samples: int, seed: int, leaf: int = 1024) -> DataFrame:
    """As ``bootstrap_replicates``, its draws from a binomial tree over blocks of ``leaf`` records: one pass over the statistics, one row a task and replicate."""
    placed = _placed(stats, base, system)
    count = placed.count()
    if not samples or not count:
        return stats.sparkSession.createDataFrame([], "replicate long, delta double")
    return _deltas_of(replicate_sums(placed, {"x": M.CHRF_COUNT, "y": M.CHRF_COUNT}, count, samples, seed, leaf))


def significance(stats: DataFrame, base: str, system: str, samples: int, seed: int, replicates: Callable[..., DataFrame] = bootstrap_replicates) -> DataFrame:
    """One row: observed delta, 95 % interval of the replicates, one-sided p, and their number; no interval for 0 samples."""
    at = lambda name: M.chrf_score(F.array(*(F.sum(F.when(F.col("system") == name, F.col("chrf")[i]).otherwise(0)) for i in range(M.CHRF_COUNT))))
    rows = stats.where(F.col("system").isin(base, system))
    observed = rows.agg((at(system) - at(base)).alias("o")).select(F.round("o", 4).alias("observed_delta"))
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    drawn = replicates(stats, base, system, samples, seed).agg(q.alias("q"), F.count_if(F.col("delta") <= 0).alias("k"), F.count("*").alias("samples"))
    out = observed.join(drawn, F.lit(True))  # one row each
    p = F.when(F.col("samples") > 0, F.round((F.col("k") + 1) / (F.col("samples") + 1), 4))
    return out.select(F.lit(base).alias("baseline"), F.lit(system).alias("system"), "observed_delta", F.round(F.col("q")[0], 4).alias("ci95_low"), F.round(F.col("q")[1], 4).alias("ci95_high"), p.alias("p_value"), "samples")


def paired_bootstrap(stats: DataFrame, base: str, system: str, samples: int, seed: int, order: str = "record_id", most: int = 1 << 16) -> dict[str, Any] | None:
    """``reference_bootstrap`` for up to ``most`` records of both systems, ``significance`` by the tree's hashed draws beyond; None without samples or records.

    ``draws`` in the result names which: their draws differ, their statistics don't.
    """
    records = stats.where(F.col("system").isin(base, system)).groupBy("record_id").agg(F.countDistinct("system").alias("n")).where("n = 2").count()
    if not samples or not records:
        return None
    if records <= most:
        return reference_bootstrap(stats, base, system, samples, seed, order, most) | {"draws": "numpy"}
    found = significance(stats, base, system, samples, seed, tree_replicates).first().asDict()
    return {k: found[k] for k in ("observed_delta", "ci95_low", "ci95_high", "p_value", "samples")} | {"draws": "hash"}


def reference_bootstrap(stats: DataFrame, base: str, system: str, samples: int, seed: int, order: str = "record_id", most: int = 1_000_000) -> dict[str, Any] | None:
    """The same on the driver with NumPy's generator, record by record in the given order: for samples of up to ``most`` records."""
    import numpy as np

    rows = stats.where(F.col("system").isin(base, system)).groupBy(order if order == "record_id" else F.col("record_id")).agg(
        *([] if order == "record_id" else [F.min(order).alias(order)]), F.max(F.when(F.col("system") == base, F.col("chrf"))).alias("x"), F.max(F.when(F.col("system") == system, F.col("chrf"))).alias("y")
    )
    got = rows.where("x IS NOT NULL AND y IS NOT NULL").orderBy(order).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} records; use the distributed form")
    if not samples or not got:
        return None
    x, y = np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], float)
    rng, found = np.random.default_rng(seed), np.empty(samples)
    for b in range(samples):
        draw = rng.integers(0, len(got), len(got))
        found[b] = M.numeric_chrf(y[draw].sum(axis=0)) - M.numeric_chrf(x[draw].sum(axis=0))
    low, high = np.percentile(found, [2.5, 97.5])
    return {
        "observed_delta": round(float(M.numeric_chrf(y.sum(axis=0)) - M.numeric_chrf(x.sum(axis=0))), 4),
        "ci95_low": round(float(low), 4),
        "ci95_high": round(float(high), 4),
        "p_value": round((int((found <= 0).sum()) + 1) / (samples + 1), 4),
        "samples": samples,
    }
