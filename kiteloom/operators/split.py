"""Splits by group, balanced by rows, and the checks that nothing leaks between them."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiteloom.sources.shared import settled

from .passages import contained_passages  # noqa: F401  one of the leakage checks

RATIOS = {"train": 0.8, "dev": 0.1, "test": 0.1}


def group_sizes(pairs: DataFrame, group: str = "group_id") -> DataFrame:
    return pairs.groupBy(group).agg(F.count("*").alias("n"))


def fold(sizes: Sequence[tuple[str, int]], ratios: Mapping[str, float], seed: int) -> dict[str, str]:
    """Deals shuffled groups, each to the split that lacks the largest share of its target, earlier splits first on ties."""
    order = sorted(sizes, key=lambda g: str(g[0]))
    random.Random(seed).shuffle(order)
    total = sum(n for _, n in order)
    target, have, out = {s: r * total for s, r in ratios.items()}, dict.fromkeys(ratios, 0), {}
    for group, n in order:
        best = max(ratios, key=lambda s: (target[s] - have[s]) / target[s])
        have[best] += n
        out[group] = best
    return out


def folded_by_hash(sizes: DataFrame, ratios: Mapping[str, float] = RATIOS, seed: int = 42, group: str = "group_id") -> DataFrame:
    """(group, split): the same dealing of the table of groups (group, n) in the order of their digests.

    Each choice hangs on all before it, so one task goes through the sorted
    groups, of which it holds a batch and a counter a split: time grows in
    proportion, memory not at all. Only names and sizes go there; Spark sorts
    them, on disk if need be.
    """
    named = sizes.select(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")).cast("binary")).alias("h"), group, F.col("n").cast("long").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    names, target = list(ratios), [total * r for r in ratios.values()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [0] * len(names)
        places = range(len(names))
        for batch in batches:
            dealt = []
            for n in batch.column(2).to_pylist():
                best = max(places, key=lambda i: (target[i] - have[i]) / target[i])  # the first of equal ones
                have[best] += n
                dealt.append(names[best])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(dealt, pa.string())], names=[group, "split"])

    schema = T.StructType([T.StructField(group, sizes.schema[group].dataType), T.StructField("split", T.StringType())])
    return named.repartition(1).sortWithinPartitions("h", group, "n").mapInArrow(run, schema)


def split_groups(pairs: DataFrame, ratios: Mapping[str, float] = RATIOS, seed: int = 42, rng: str = "reference", group: str = "group_id", broadcast_groups: int = 1_000_000, broadcast_bytes: int = 48 << 20) -> DataFrame:
    """``pairs`` with ``split``; every group lies in one split.

    ``rng="reference"`` shuffles with Python's generator on the driver, where only
    groups and their sizes come; ``"hash"`` streams them, sorted, through one task.
    Both deal one group after the other: the first is for as many groups as fit
    the driver, the second for any number. ``"ranges"`` puts
    a group where the hash of its name falls among the cumulated ratios: no
    table of groups at all, and balance by the law of large numbers. Fewer than
    three groups, or columns that are missing, raise ``ValueError``.
    """
    missing = sorted({"record_id", group, "source", "target"} - set(pairs.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if rng == "ranges":
        at = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        edge, out = 0.0, None
        for name, ratio in list(ratios.items())[:-1]:
            edge += ratio
            out = F.when(at < edge, name) if out is None else out.when(at < edge, name)
        return pairs.withColumn("split", out.otherwise(list(ratios)[-1]))
    sizes = settled(group_sizes(pairs, group), "groups")
    named = F.coalesce(F.octet_length(F.col(group).cast("string")), F.lit(0))
    count, size = sizes.agg(F.count("*"), F.coalesce(F.sum(named), F.lit(0))).first()
    if count < len(ratios):
        raise ValueError(f"{len(ratios)} groups are needed at least, there are {count}")
    if rng == "hash":
        table = folded_by_hash(sizes, ratios, seed, group)
    elif rng == "reference":
        dealt = fold([(r[0], r[1]) for r in sizes.toLocalIterator()], ratios, seed)
        table = pairs.sparkSession.createDataFrame(list(dealt.items()), f"`{group}` {pairs.schema[group].dataType.simpleString()}, split string")
    else:
        raise ValueError(f"unknown rng: {rng}")
    return pairs.join(F.broadcast(table) if count <= broadcast_groups and size <= broadcast_bytes else table, group)


def overlaps(rows: DataFrame, keys: Sequence[str] = ("group_id", "source", "target", "record_id")) -> DataFrame:
    """(key, value, splits) of values that lie in several splits, all keys in one pass."""
    long = rows.select("split", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("x")).select("split", "x.*")
    return long.groupBy("key", "value").agg(F.sort_array(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def require_no_leakage(rows: DataFrame, ratios: Mapping[str, float] = RATIOS, keys: Sequence[str] = ("group_id", "source", "target", "record_id")) -> None:
    """Raises ``ValueError`` if splits are missing or others there, or a value lies in several: the key, splits and first five values."""
    names = {r[0] for r in rows.select("split").distinct().limit(len(ratios) + 1).collect()}
    if names != set(ratios):
        raise ValueError(f"splits are {sorted(map(str, names))}, expected {sorted(ratios)}")
    found = overlaps(rows, keys).groupBy("key", "splits").agg(F.count("*").alias("values")).orderBy("key", "splits").first()
    if found:
        first = overlaps(rows, keys).where((F.col("key") == found["key"]) & (F.col("splits") == F.lit(found["splits"]))).orderBy("value").limit(5).collect()
        raise ValueError(f"{found['values']} values of {found['key']} lie in {found['splits']}; first: {[r['value'] for r in first]}")
