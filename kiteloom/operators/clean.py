"""Cleaning of parallel pairs: an ordered rule cascade with a lossless audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiteloom.functions import text as X

ROW = "raw_row_number"
CANONICAL = ("record_id", "group_id", "source", "target", "source_language", "target_language", "dataset_source")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the cascade."""

    min_text_chars: int = 2
    min_script_ratio: float = 0.50
    min_length_ratio: float = 0.25
    max_length_ratio: float = 2.00
    drop_duplicates: bool = True
    blocks: Sequence[tuple[int, int]] = X.DEVANAGARI


def profile(df: DataFrame, rules: Rules = Rules(), normalized: bool = True) -> DataFrame:
    """Normalizes both sides (unless ``normalized`` is False) and measures them, row by row."""
    if normalized:
        df = df.withColumns({c: X.normalize(F.col(c)) for c in ("source", "target")})
    return df.withColumns(
        {
            "source_chars": F.length("source"),
            "target_chars": F.length("target"),
            "source_content": X.content_chars(F.col("source")),
            "target_content": X.content_chars(F.col("target")),
            "length_ratio": X.length_ratio(F.col("source"), F.col("target")),
            "source_script_ratio": X.script_ratio(F.col("source"), rules.blocks),
        }
    )


def first_reason(rules: Rules = Rules()) -> Column:
    """The first rule that a profiled row fails by itself; "" if none. Bounds of the length ratio are kept."""
    checks = (
        ("empty_source", F.col("source") == ""),
        ("empty_target", F.col("target") == ""),
        ("source_too_short", F.col("source_content") < rules.min_text_chars),
        ("target_too_short", F.col("target_content") < rules.min_text_chars),
        ("low_source_script_ratio", F.col("source_script_ratio") < rules.min_script_ratio),
        ("extreme_length_ratio", ~F.col("length_ratio").between(rules.min_length_ratio, rules.max_length_ratio)),
    )
    out = F.when(checks[0][1], checks[0][0])
    for name, failed in checks[1:]:
        out = out.when(failed, name)
    return out.otherwise("")


def cascade(df: DataFrame, rules: Rules = Rules(), normalized: bool = True) -> DataFrame:
    """All rows with ``reason``: "" if kept, else the first rule that fails.

    Needs record_id, group_id, source, target and a total order in
    ``raw_row_number``. Of the rows that pass by themselves, those whose source
    has several targets conflict, and all but the first of equal pairs are
    duplicates. Pairs are counted before any row is moved: a source or pair that
    fills a third of the table is combined in each task first, and in the join
    that takes the counts back to the rows it is a large side that can be split.
    """
    rows = profile(df, rules, normalized).withColumn("reason", first_reason(rules))
    pairs = rows.where("reason = ''").groupBy("source", "target").agg(F.min(ROW).alias("first_row"))
    several = pairs.groupBy("source").count().where("count > 1").select("source", F.lit(True).alias("several"))
    facts = pairs.join(several, "source", "left").select(F.col("source").alias("_s"), F.col("target").alias("_t"), "first_row", "several")
    valid = F.col("reason") == ""
    # Rows that are out already have no partner to look for; their keys stay apart from each other.
    met = rows.withColumn("_out", F.when(valid, F.lit("")).otherwise(F.col(ROW).cast("string")))
    met = met.join(facts.withColumn("_in", F.lit("")), (F.col("_out") == F.col("_in")) & (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_t")), "left")
    later = F.when(~valid, F.col("reason")).when(F.col("several"), "conflicting_source_translation")
    if rules.drop_duplicates:
        later = later.when(F.col(ROW) > F.col("first_row"), "exact_duplicate_pair")
    return met.withColumn("reason", later.otherwise("")).drop("_out", "_in", "_s", "_t", "first_row", "several")


def audit(rows: DataFrame) -> DataFrame:
    """One row for each row of the cascade, kept or dropped."""
    return rows.select(
        ROW,
        "record_id",
        "group_id",
        F.when(F.col("reason") == "", "kept").otherwise("dropped").alias("status"),
        "reason",
        "source_chars",
        "target_chars",
        F.round("length_ratio", 6).alias("length_ratio"),
        F.round("source_script_ratio", 6).alias("source_script_ratio"),
    )


def kept(rows: DataFrame, source_language: str, target_language: str, dataset: str) -> DataFrame:
    """The canonical pairs of the kept rows, with their row number."""
    return rows.where("reason = ''").select(
        ROW, "record_id", "group_id", "source", "target", F.lit(source_language).alias("source_language"), F.lit(target_language).alias("target_language"), F.lit(dataset).alias("dataset_source")
    )


def drop_counts(rows: DataFrame) -> DataFrame:
    """(reason, rows) of dropped rows."""
    return rows.where("reason <> ''").groupBy("reason").agg(F.count("*").alias("rows"))


def conflicting_sources(pairs: DataFrame) -> DataFrame:
    """(source, targets) of sources with several distinct targets."""
    return pairs.groupBy("source").agg(F.countDistinct("target").alias("targets")).where("targets > 1")


def duplicate_pairs(pairs: DataFrame) -> DataFrame:
    """(source, target, copies, first_row) of pairs that stand in several rows."""
    return pairs.groupBy("source", "target").agg(F.count("*").alias("copies"), F.min(ROW).alias("first_row")).where("copies > 1")


def require_clean(pairs: DataFrame, rules: Rules = Rules()) -> None:
    """Raises ``ValueError`` if no pair is left, an id or (if they were to go) a pair repeats, or a source conflicts."""
    if pairs.isEmpty():
        raise ValueError("no pair is left after cleaning")
    faults = {
        "repeated record_id": pairs.groupBy("record_id").count().where("count > 1"),
        "conflicting source": conflicting_sources(pairs),
    }
    if rules.drop_duplicates:
        faults["repeated pair"] = duplicate_pairs(pairs)
    found = [name for name, rows in faults.items() if not rows.isEmpty()]
    if found:
        raise ValueError(f"after cleaning there still are: {found}")
