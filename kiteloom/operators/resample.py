"""Bootstrap weights from a tree: how often each place is drawn in each replicate, without a row for each draw.

The draws of a replicate over n places fall into blocks of places. How many fall
into each is a multinomial, drawn by halving: of the draws of a range of blocks,
a binomial number go to its left half. Every number is a hash of the seed, the
replicate and the range, so any task finds its blocks' counts by going down the
tree, whoever else does so. Inside a block the draws are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the SplitMix64 generator, so that SQL can draw the same.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    """One step of SplitMix64 over unsigned 64-bit numbers, overflow wrapping."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, np.uint64) + np.uint64(STEP)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
        return z ^ (z >> np.uint64(31))


def hashed(seed: int, *parts: np.ndarray | int) -> np.ndarray:
    """The hash of a seed and numbers, each added to the hash of those before."""
    out = mixed(np.uint64(seed % (1 << 64)))
    with np.errstate(over="ignore"):
        for part in parts:
            out = mixed(out + np.asarray(part, np.uint64))
    return out


def binomial(u: np.ndarray, counts: np.ndarray, share: float, most: int = 1 << 21) -> np.ndarray:
    """For each u in [0, 1) the least k that a binomial of ``counts`` trials doesn't exceed with a probability over u.

    Probabilities come from ratios of neighbours, starting at the mean, over nine
    standard deviations to both sides; what lies beyond is under 10^-17.
    """
    if share >= 1:
        return counts.copy()
    out, odds = np.empty_like(counts), share / (1 - share)
    width = int(9 * np.sqrt(max(counts.max(initial=0), 1) * share * (1 - share))) + 12
    step = max(1, most // (2 * width + 1))
    for at in range(0, len(counts), step):
        c, own = counts[at : at + step, None].astype(float), u[at : at + step]
        middle = np.floor(c * share)
        up = middle + np.arange(width)
        down = middle - np.arange(width)
        rising = np.cumprod(np.clip((c - up) / (up + 1) * odds, 0, None), axis=1)  # of middle + 1, middle + 2, ... relative to middle
        falling = np.cumprod(np.clip(down / (c - down + 1) / odds, 0, None), axis=1)
        weights = np.concatenate([falling[:, ::-1], np.ones((len(c), 1)), rising], axis=1)
        sums = np.cumsum(weights, axis=1)
        out[at : at + step] = middle[:, 0] - width + (sums <= own[:, None] * sums[:, -1:]).sum(axis=1)
    return np.clip(out, 0, counts)


class Tree:
    """The counts of ``samples`` replicates of ``places`` draws in blocks of ``leaf`` places."""

    def __init__(self, places: int, samples: int, seed: int, leaf: int) -> None:
        self.places, self.seed, self.leaf = places, seed, leaf
        self.replicates = np.arange(samples, dtype=np.int64)
        self.blocks = -(-places // leaf)
        self.path = [(0, self.blocks, np.full(samples, places, np.int64))]

    def _size(self, lo: int, hi: int) -> int:
        return min(hi * self.leaf, self.places) - lo * self.leaf

    def counts(self, block: int) -> np.ndarray:
        """How many draws of each replicate fall into a block. What the last block asked for has in common with it isn't drawn again."""
        while not self.path[-1][0] <= block < self.path[-1][1]:
            self.path.pop()
        while self.path[-1][1] - self.path[-1][0] > 1:
            lo, hi, whole = self.path[-1]
            middle = (lo + hi) // 2
            u = (hashed(self.seed, self.replicates, lo, hi) >> np.uint64(11)) * 2.0**-53
            left = binomial(u, whole, self._size(lo, middle) / self._size(lo, hi))
            self.path.append((lo, middle, left) if block < middle else (middle, hi, whole - left))
        return self.path[-1][2]

    def weights(self, block: int) -> np.ndarray:
        """How often each replicate draws each place of a block, a row a replicate."""
        counts, size = self.counts(block), self._size(block, block + 1)
        owner = np.repeat(self.replicates, counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        base = hashed(self.seed + 1, self.replicates, block)
        with np.errstate(over="ignore"):
            place = mixed(base[owner] + nth.astype(np.uint64)) % np.uint64(size)
        return np.bincount(owner * size + place.astype(np.int64), minlength=len(counts) * size).reshape(-1, size)


def replicate_sums(placed: DataFrame, columns: Mapping[str, int], places: int, samples: int, seed: int, leaf: int = 1024) -> DataFrame:
    """(replicate, ...): of each replicate the sums of the arrays in ``columns`` over its draws, with repeats, of the rows of ``placed`` (place, ...).

    ``place`` numbers all rows from 0 to ``places`` - 1; ``columns`` gives the
    arrays of whole numbers and how long they are. Any task may hold any places: it
    draws the blocks that it meets, and its rows' share of them. A task sends
    one row a replicate. No rows and no samples give none.
    """
    kept = placed.select("place", *columns).sortWithinPartitions("place")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, total, sizes = Tree(places, samples, seed, leaf), None, list(columns.values())
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(0).to_numpy()
            stats = np.concatenate([batch.column(i + 1).flatten().to_numpy().reshape(-1, n).astype(np.int64) for i, n in enumerate(sizes)], axis=1)
            total = np.zeros((samples, sum(sizes)), np.int64) if total is None else total
            blocks = place // leaf
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(place)]
            for lo, hi in zip(edges, edges[1:]):
                drawn = tree.weights(int(blocks[lo]))[:, place[lo:hi] - blocks[lo] * leaf]
                own = stats[lo:hi]
                exact = np.abs(own).max(initial=0) * float(places) < 1 << 53  # products of doubles are then whole numbers
                total += (drawn.astype(float) @ own.astype(float)).astype(np.int64) if exact else drawn @ own
        if total is not None:
            cuts = np.cumsum(sizes)[:-1]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(samples + 1) * part.shape[1], pa.int32()), pa.array(np.ascontiguousarray(part).reshape(-1))) for part in np.split(total, cuts, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), *lists], names=["replicate", *columns])

    schema = T.StructType.fromDDL("replicate long")
    for column in columns:
        schema = schema.add(column, T.ArrayType(T.LongType()))
    each = kept.mapInArrow(run, schema)
    return each.groupBy("replicate").agg(*(F.array(*(F.sum(F.col(c)[i]) for i in range(n))).alias(c) for c, n in columns.items()))


def mixed_sql(x: str) -> str:
    """``mixed`` in DuckDB's SQL, of an unsigned 64-bit expression held as a 128-bit one."""
    wide, modulus = "::UHUGEINT", "18446744073709551616::UHUGEINT"
    steps = [f"(({x}){wide} + {STEP}{wide}) % {modulus}"]
    for shift, factor in ((30, FIRST), (27, SECOND)):
        steps.append(f"(xor(z, z // {1 << shift}{wide}) * {factor}{wide}) % {modulus}")
    steps.append(f"xor(z, z // {1 << 31}{wide})")
    out = steps[0]
    for step in steps[1:]:
        out = f"list_transform([{out}], lambda z: {step})[1]"
    return out


def hashed_sql(seed: int, *parts: str) -> str:
    out = mixed_sql(str(seed % (1 << 64)))
    for part in parts:
        out = mixed_sql(f"{out} + ({part})::UHUGEINT")
    return out


def weights_sql(places: str, samples: int, seed: int, leaf: int, depth: int, name: str = "weights") -> str:
    """CTEs that end in ``name`` (replicate, place, w): the tree's draws in DuckDB's SQL, for up to 2^``depth`` blocks; ``places`` counts them."""
    size = lambda lo, hi: f"(least({hi} * {leaf}, n) - {lo} * {leaf})"
    parts = [f"{name}_0 AS (SELECT b, 0::BIGINT AS lo, ((n + {leaf - 1}) // {leaf})::BIGINT AS hi, n AS c, n FROM (SELECT unnest(range({samples})) AS b), (SELECT ({places})::BIGINT AS n))"]
    for k in range(depth):
        parts.append(
            f"""{name}_{k}_split AS (
  SELECT b, lo, hi, c, n, (lo + hi) // 2 AS mid, {size('lo', '((lo + hi) // 2)')}::DOUBLE / {size('lo', 'hi')} AS p,
    ({hashed_sql(seed, 'b', 'lo', 'hi')} // 2048::UHUGEINT)::DOUBLE / 9007199254740992.0::DOUBLE AS u FROM {name}_{k} WHERE hi - lo > 1),
{name}_{k}_sums AS (
  SELECT b, lo, hi, k, u, sum(w) OVER (PARTITION BY b, lo ORDER BY k) AS s, sum(w) OVER (PARTITION BY b, lo) AS t FROM (
    SELECT *, exp(lgamma(c + 1) - lgamma(k + 1) - lgamma(c - k + 1) + k * ln(p) + (c - k) * ln(1 - p)) AS w FROM (SELECT *, unnest(range(c + 1)) AS k FROM {name}_{k}_split WHERE c > 0))),
{name}_{k}_left AS (SELECT b, lo, count(*) FILTER (s <= u * t)::BIGINT AS a FROM {name}_{k}_sums GROUP BY b, lo),
{name}_{k}_done AS (SELECT x.*, least(COALESCE(a, 0), c) AS a FROM {name}_{k}_split x LEFT JOIN {name}_{k}_left USING (b, lo)),
{name}_{k + 1} AS (
  SELECT b, lo, hi, c, n FROM {name}_{k} WHERE hi - lo = 1
  UNION ALL SELECT b, lo, mid, a, n FROM {name}_{k}_done UNION ALL SELECT b, mid, hi, c - a, n FROM {name}_{k}_done)"""
        )
    drawn = hashed_sql(seed + 1, "b", "lo", "t")
    parts.append(
        f"""{name} AS (SELECT b AS replicate, (lo * {leaf} + x)::BIGINT AS place, count(*) AS w FROM (
  SELECT b, lo, ({drawn} % {size('lo', '(lo + 1)')}::UHUGEINT)::BIGINT AS x FROM (SELECT *, unnest(range(c)) AS t FROM {name}_{depth})) GROUP BY ALL)"""
    )
    return ",\n".join(parts)
