"""The data preparation plan: raw file to frozen splits, audit and reports."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.control.config import Experiment
from kiteloom.control.run import Layout, RunState
from kiteloom.functions.text import DEVANAGARI
from kiteloom.operators import clean, split, summary
from kiteloom.sources import readers, sinks
from kiteloom.sources.shared import settled

MEASURES = ("source_chars", "target_chars", "length_ratio", "source_script_ratio")


def rules_of(settings: Experiment, blocks=DEVANAGARI) -> clean.Rules:
    d = settings.dataset
    return clean.Rules(d.min_text_chars, d.min_source_script_ratio, d.min_length_ratio, d.max_length_ratio, d.remove_exact_duplicates, blocks)


def read_raw(spark: SparkSession, settings: Experiment, path: str | Path) -> DataFrame:
    """The raw file under canonical names, its keys checked."""
    d = settings.dataset
    names = {d.record_column: "record_id", d.group_column: "group_id", d.source_column: "source", d.target_column: "target"}
    raw = readers.read_delimited(spark, path, names, d.delimiter, d.encoding)
    readers.require_rows(raw)
    readers.require_keys(raw, "record_id", "group_id")
    readers.require_unique(raw, "record_id")
    return raw.select(clean.ROW, "record_id", "group_id", "source", "target")


def cleaned(spark: SparkSession, settings: Experiment, raw: DataFrame, rng: str = "reference") -> tuple[DataFrame, DataFrame]:
    """(audit with split, split pairs). The cascade is written once and read by both, and by every summary."""
    rows = settled(clean.cascade(raw, rules_of(settings)), "cascade")
    pairs = clean.kept(rows, settings.model.source_language, settings.model.target_language, settings.project.name)
    clean.require_clean(pairs, rules_of(settings))
    d = settings.dataset
    ratios = {"train": d.train_ratio, "dev": d.dev_ratio, "test": d.test_ratio}
    dealt = settled(split.split_groups(pairs, ratios, settings.project.seed, rng), "splits")
    split.require_no_leakage(dealt, ratios)
    where = dealt.select(F.col("record_id").alias("_id"), "split")
    audited = clean.audit(rows).join(where, F.col("record_id") == F.col("_id"), "left").drop("_id").withColumn("split", F.coalesce("split", F.lit("")))
    return audited, dealt


def prepare(spark: SparkSession, settings: Experiment, path: str | Path | None = None, rng: str = "reference") -> dict[str, Any]:
    """Runs the plan, writes splits, sidecar, audit and reports, and returns the data report. A failure marks the stage failed."""
    layout = Layout(settings)
    layout.create()
    state = RunState(layout.report("run_state.json"), settings.run.run_id)
    state.started("data_preparation")
    try:
        report = _prepare(spark, settings, layout, path or settings.paths.raw_data_file, rng)
    except Exception as error:
        state.failed("data_preparation", f"{type(error).__name__}: {error}")
        raise
    state.completed("data_preparation", f"{report['cleaning_result']['rows_kept']} rows kept")
    return report


def _prepare(spark: SparkSession, settings: Experiment, layout: Layout, path: str | Path | None, rng: str) -> dict[str, Any]:
    if path is None:
        raise ValueError("no raw data file is given")
    digest = readers.file_digest(path)
    raw = read_raw(spark, settings, path)
    audited, dealt = cleaned(spark, settings, raw, rng)
    d = settings.dataset
    ratios = {"train": d.train_ratio, "dev": d.dev_ratio, "test": d.test_ratio}
    files = {}
    for name in ratios:
        own = dealt.where(F.col("split") == name)
        files[name] = {"file": str(layout.split(name)), "sha256": sinks.write_frozen(own, layout.split(name), [clean.ROW], clean.CANONICAL)}
    sinks.write_frozen(audited, layout.report("data_cleaning_report.csv"), [clean.ROW], sep=",")
    sinks.write_sidecar(layout.split("test"), layout.report("test_set.sha256"))

    pairs = dealt.drop("split")
    total = summary.retention(audited, pairs).first().asDict()
    drops = {r["reason"]: r["rows"] for r in audited.where("status = 'dropped'").groupBy("reason").agg(F.count("*").alias("rows")).orderBy("reason").collect()}
    stats = {r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in summary.numeric_summary(audited.where("status = 'kept'"), *MEASURES).collect()}
    splits = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} | files[r["split"]] for r in summary.split_summary(dealt).collect()}
    leaks = {r["key"]: r["n"] for r in split.overlaps(dealt).groupBy("key").agg(F.count("*").alias("n")).collect()}
    report = {
        "schema_version": 1,
        "raw_dataset": {"file": str(path), "sha256": digest, "rows": total["raw_rows"], "unique_record_ids": total["unique_record_ids"], "unique_group_ids": total["unique_group_ids"]},
        "column_mapping": {"record_id": d.record_column, "group_id": d.group_column, "source": d.source_column, "target": d.target_column},
        "cleaning_result": {
            "rows_kept": total["rows_kept"],
            "rows_dropped": total["rows_dropped"],
            "retention_fraction": total["retention_fraction"],
            "unique_groups_kept": total["unique_groups_kept"],
            "identical_source_target_rows_kept": total["identical_rows_kept"],
            "drop_counts": drops,
        },
        "kept_data_statistics": stats,
        "splits": splits,
        "leakage_checks": {k: leaks.get(k, 0) > 0 for k in ("group_id", "source", "target", "record_id")},
    }
    sinks.write_json(report, layout.report("data_report.json"))
    frozen = {"schema_version": 1, "seed": settings.project.seed, "method": f"groups balanced by rows, rng {rng}", "group_key": "group_id", "requested_ratios": ratios}
    sinks.write_json(frozen | {"clean_rows": total["rows_kept"], "clean_groups": total["unique_groups_kept"], "splits": splits, "test_set_sha256": files["test"]["sha256"]}, layout.report("split_manifest.json"))
    return report
