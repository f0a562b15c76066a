"""Sources: delimited tables, JSON stores and documents, tensors, checkpoint folders."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiteloom.functions.text import WHITE, text_of

from . import tensors
from .delimited import quoted_records

ROW_NUMBER = "raw_row_number"


def read_delimited(spark: SparkSession, path: str | Path, columns: dict[str, str] | None = None, sep: str = "\t", encoding: str = "utf-8", required: Sequence[str] = (), line_breaks: bool = True) -> DataFrame:
    """A delimited file with a header as strings, none inferred, with ``raw_row_number`` (the header is line 1).

    ``columns`` maps column names to new ones and makes them required; other
    columns stay. Cells that are empty or missing are "", "NA" stays text, fields
    may be quoted with doubled quotes inside and hold separators and line breaks.
    ``utf-8-sig`` takes a byte order mark off the header.

    A file is read by as many tasks as it has splits, also where quoted fields
    hold line breaks (``quoted_records``); ``line_breaks=False`` says that there
    are none, which saves a look at all quotes. Row numbers follow the order of
    files and rows.
    """
    path = str(path)
    if "://" not in path:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        if not os.path.isfile(path) and not any(Path(path).iterdir()):
            raise ValueError(f"not a file, and no files in it: {path}")
    options = {"sep": sep, "quote": '"', "escape": '"', "encoding": "utf-8"}
    raw = spark.read.options(**options, multiLine=line_breaks, header=True, inferSchema=False).csv(path)
    names = [c.removeprefix("\ufeff") if encoding == "utf-8-sig" else c for c in raw.columns]
    require_columns(raw.toDF(*names), [*(columns or {}), *required])
    named = lambda cells: [text_of(c).alias((columns or {}).get(name, name)) for c, name in zip(cells, names)]
    if not line_breaks:
        raw = raw.toDF(*(f"c{i}" for i in range(len(names))))
        rows = raw.withColumn("_order", F.monotonically_increasing_id())
        return _dense(rows.select(*named(map(F.col, raw.columns)), "_order"), "_order", ROW_NUMBER, first=2)
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.from_csv(F.col("record"), F.lit(fields), {**options, "multiLine": "true"})
    rows = quoted_records(spark, path, sep).select("row", cells.alias("c"))
    return rows.select(*named(F.col(f"c.c{i}") for i in range(len(names))), F.col("row").alias(ROW_NUMBER))


def _dense(df: DataFrame, order: str, name: str, first: int) -> DataFrame:
    """Replaces an increasing id by dense numbers: the id's upper bits are its task, whose offset comes from the sizes before it."""
    task = F.shiftright(order, 33)
    sizes = df.groupBy(task.alias("_t")).agg(F.count("*").alias("_n"))
    before = sizes.select("_t", F.coalesce(F.sum("_n").over(W.orderBy("_t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    number = F.col(order).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_b") + first
    return df.join(F.broadcast(before), task == F.col("_t")).withColumn(name, number).drop(order, "_t", "_b")


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raises ``ValueError`` that names missing and available columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}; available columns: {sorted(df.columns)}")


def require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("the table has no rows")


def blank_keys(df: DataFrame, *keys: str) -> DataFrame:
    """One row with the number of rows whose key is blank, for each key."""
    blank = lambda c: F.regexp_replace(text_of(F.col(c)), f"^{WHITE}+|{WHITE}+$", "") == ""
    return df.agg(*(F.count_if(blank(c)).alias(c) for c in keys))


def require_keys(df: DataFrame, *keys: str) -> None:
    counts = {k: n for k, n in blank_keys(df, *keys).first().asDict().items() if n}
    if counts:
        raise ValueError(f"blank keys, rows by column: {counts}")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, rows, first_row) of keys that stand in more than one row; ``raw_row_number`` orders them if there is one."""
    first = F.min(ROW_NUMBER) if ROW_NUMBER in df.columns else F.min(key)
    return df.groupBy(key).agg(F.count("*").alias("rows"), first.alias("first_row")).where("rows > 1")


def require_unique(df: DataFrame, key: str) -> None:
    """Raises ``ValueError`` with the number of rows concerned and the first five keys."""
    again = repeated_keys(df, key)
    total = again.agg(F.sum("rows")).first()[0]
    if total:
        raise ValueError(f"{total} rows share a {key}; first: {[r[0] for r in again.orderBy('first_row', key).limit(5).collect()]}")


PREPARED = ("record_id", "group_id", "source", "target")


def read_prepared(spark: SparkSession, path: str | Path) -> DataFrame:
    """A prepared split: tab-separated, with the four canonical columns at least."""
    return read_delimited(spark, path, required=PREPARED)


def read_store(spark: SparkSession, path: str | Path) -> DataFrame:
    """A store of JSON lines as (record_id, prediction, row), the last line of each record.

    Lines that aren't whole JSON objects with both keys are skipped; a null
    prediction is kept; a missing file is an empty store. ``row`` is the line.
    """
    schema = "record_id string, prediction string, row string"
    if "://" not in str(path) and not os.path.exists(path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(str(path)).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return last_written(lines, "value", "file", "line")


def last_written(lines: DataFrame, value: str, *order: str) -> DataFrame:
    """The last sound line of each record; combined before the shuffle, so a record written often is no burden."""
    keys = F.json_object_keys(F.col(value))
    sound = lines.where(F.array_contains(keys, "record_id") & F.array_contains(keys, "prediction"))
    read = sound.select(F.get_json_object(value, "$.record_id").alias("record_id"), F.get_json_object(value, "$.prediction").alias("prediction"), F.col(value).alias("row"), F.struct(*order).alias("at"))
    last = read.groupBy("record_id").agg(F.max(F.struct("at", "prediction", "row")).alias("last"))
    return last.select("record_id", "last.prediction", "last.row")


def read_stores(spark: SparkSession, folder: str | Path, prefix: str = "predictions_") -> DataFrame:
    """All stores of a folder with their system's name, from the file name; raises ``FileNotFoundError`` if there is none."""
    systems = store_systems(folder, prefix)
    out = None
    for system in systems:
        own = read_store(spark, Path(folder) / f"{prefix}{system}.jsonl").select(F.lit(system).alias("system"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def store_systems(folder: str | Path, prefix: str = "predictions_") -> list[str]:
    """Sorted names of the systems that have a store."""
    found = sorted(p.stem.removeprefix(prefix) for p in Path(folder).glob(f"{prefix}*.jsonl"))
    if not found:
        raise FileNotFoundError(f"no {prefix}*.jsonl in {folder}")
    return found


def read_results(spark: SparkSession, path: str | Path, numbers: Sequence[str]) -> DataFrame:
    """A comma-separated table of results: strings, and the named columns as doubles."""
    rows = read_delimited(spark, path, sep=",")
    return rows.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in numbers})


def read_json(path: str | Path, lenient: bool = False) -> dict[str, Any]:
    """A JSON document; it must be an object. If ``lenient``, a missing file is an empty one."""
    path = Path(path)
    if lenient and not path.exists():
        return {}
    found = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"not a JSON object: {path}")
    return found


_CHECKPOINT = re.compile(r"checkpoint-(\d+)")
_ADAPTER = re.compile(r"(.+)\.lora_([AB])\.weight")


def checkpoint_step(name: str) -> int | None:
    """The step in a checkpoint folder's name."""
    found = _CHECKPOINT.fullmatch(name)
    return int(found[1]) if found else None


def scan_checkpoints(folder: str | Path) -> list[tuple[int, Path]]:
    """(step, folder) of all checkpoints, the newest first."""
    folder = Path(folder)
    found = [(checkpoint_step(p.name), p) for p in folder.iterdir() if p.is_dir()] if folder.is_dir() else []
    return sorted(((s, p) for s, p in found if s is not None), reverse=True)


def read_tensors(path: str | Path) -> dict[str, Any]:
    """A small tensor file's arrays as doubles, on the driver; ``read_slices`` is for files of any size."""
    out = {}
    begin, header = tensors.read_header(str(path))
    with open(path, "rb") as file:
        for name, at in header.items():
            lo, hi = at["data_offsets"]
            file.seek(begin + lo)
            out[name] = tensors.as_doubles(file.read(hi - lo), at["dtype"]).reshape(at["shape"])
    return out


def read_adapter(spark: SparkSession, path: str | Path) -> DataFrame:
    """(path, which, matrix) of an adapter's halves A and B, read by tasks; other tensors are left out."""
    name = f"^{_ADAPTER.pattern}$"
    slices = tensors.read_slices(spark, str(path)).where(F.rlike("tensor", F.lit(name)))
    whole = slices.groupBy("file", "tensor").agg(F.first("shape").alias("shape"), F.array_sort(F.collect_list(F.struct("first", "values"))).alias("parts"))
    flat, rows, width = F.flatten(F.col("parts.values")), F.col("shape")[0], F.col("shape")[1].cast("int")
    matrix = F.when(rows > 0, F.transform(F.sequence(F.lit(0).cast("long"), rows - 1), lambda i: F.slice("flat", (i * width + 1).cast("int"), width))).otherwise(F.array().cast("array<array<double>>"))
    half = lambda i: F.regexp_extract("tensor", name, i)
    return whole.withColumn("flat", flat).select(half(1).alias("path"), half(2).alias("which"), matrix.alias("matrix"))


def weights_digest(path: str | Path) -> str:
    """SHA-256 over all tensors of a file in the order of their names: each name, then its values as 32-bit floats. No tensors raise ``ValueError``.

    One digest is one chain over all bytes, so one process reads them, a slice
    at a time; ``tree_digest`` is the form that many tasks compute.
    """
    return tensors.streamed_digest(str(path))


def file_digest(path: str | Path) -> str:
    """SHA-256 of a file, in hex."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def read_sidecar(path: str | Path) -> str:
    """The digest in a sidecar: its first word."""
    return Path(path).read_text(encoding="utf-8").split()[0]


def read_verified(spark: SparkSession, path: str | Path, sidecar: str | Path) -> tuple[DataFrame, str]:
    """A prepared split whose digest must be the sidecar's, and the digest."""
    own, said = file_digest(path), read_sidecar(sidecar)
    if own != said:
        raise ValueError(f"{path} has the digest {own}, its sidecar says {said}")
    return read_prepared(spark, path), own
