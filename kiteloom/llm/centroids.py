"""Centroid clustering of integer vectors, exact: distances by blocked matrix products, sums by a tree of tasks."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, schema_of

#: Doubles hold every whole number up to this one.
EXACT = 1 << 53


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) of doubles, exactly: doubles where all fit below ``EXACT``, else Python's own integers.

    ``scale`` must be a power of two, so that the product of doubles isn't rounded.
    """
    with np.errstate(over="ignore"):
        product = np.floor(values * float(scale))
    large = np.abs(product) >= EXACT
    if not large.any():
        return product
    out = np.where(large, 0.0, product).astype(np.int64).astype(object)
    # Doubles of EXACT and above have no fraction, and neither have those whose product overflows.
    out[large] = [int(p) if abs(p) < float("inf") else int(x) * scale for p, x in zip(product[large].tolist(), values[large].tolist())]
    return out


def vectors_of(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the sound lists of a batch (``dims`` finite doubles, no null) and their whole numbers, a row each."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    values = column.flatten()
    sound = np.isfinite(values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64, copy=False))
    before = np.r_[0, np.cumsum(sound)]
    starts = ends - np.maximum(sizes, 0)
    at = np.flatnonzero((sizes == dims) & (before[ends] - before[starts] == dims))
    places = starts[at, None] + np.arange(dims)
    return at, whole_numbers(values.fill_null(0.0).to_numpy(zero_copy_only=False)[places], scale)


def _magnitude(block: np.ndarray) -> int:
    return max(int(block.max()), -int(block.min())) if block.size else 0


def nearest(block: np.ndarray, centroids: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid and the squared distance to it; the smaller number on ties.

    |x|² - 2 x·c + |c|² by one matrix product of doubles. Each of its terms, and
    so each partial sum, is a whole number of at most dims * (|x| + |c|)² for the
    greatest components: below 2^53 the product is exact in any order of adding.
    Rows beyond that bound are measured in integers, of 64 bits while the
    distances fit them, else of any length.
    """
    dims = len(centroids[0])
    far = max(abs(v) for c in centroids for v in c)
    bound = isqrt((EXACT - 1) // max(dims, 1)) - far  # the greatest component with which the product is exact
    if block.dtype != object and _magnitude(block) <= bound:
        c = np.array(centroids, np.float64)
        found = (block * block).sum(axis=1)[:, None] - 2.0 * (block @ c.T) + (c * c).sum(axis=1)
        cluster = found.argmin(axis=1)
        return cluster, found[np.arange(len(block)), cluster].astype(np.int64)
    size = np.abs(block).max(axis=1)
    small = np.array([v <= bound for v in size.tolist()], bool)
    cluster, distance = np.zeros(len(block), np.int64), np.zeros(len(block), object)
    if small.any():
        cluster[small], distance[small] = nearest(block[small].astype(np.float64), centroids)
    for i in np.flatnonzero(~small):
        row = [int(v) for v in block[i].tolist()]
        if dims * (max(map(abs, row)) + far) ** 2 < 1 << 63:
            every = ((np.array(row, np.int64) - np.array(centroids, np.int64)) ** 2).sum(axis=1).tolist()
        else:
            every = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids]
        distance[i] = min(every)
        cluster[i] = every.index(distance[i])
    return cluster, distance


def _blocks(batches: Iterable[pa.RecordBatch], dims: int, scale: int, rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, places of its sound vectors, vectors) in blocks; the vectors are the batch's last column."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            places, block = vectors_of(some.column(some.num_columns - 1), dims, scale)
            if len(places):
                yield some, places, block


def _sums(centroids: list[tuple[int, ...]], scale: int):
    """A task's vectors to one row: for each cluster its count and componentwise sums, pickled."""
    dims = len(centroids[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dims + 1), object)
        for _, _, block in _blocks(batches, dims, scale):
            cluster, _ = nearest(block, centroids)
            if block.dtype != object and _magnitude(block) * len(block) < EXACT:
                member = (np.arange(len(centroids))[:, None] == cluster).astype(np.float64)
                total += np.c_[member.sum(axis=1), member @ block].astype(np.int64).astype(object)
            else:
                for c, row in zip(cluster.tolist(), block.tolist()):
                    total[c] += np.array([1, *map(int, row)], object)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total.tolist())], pa.binary())], names=["sums"])

    return run


def _added(a: list[list[int]] | None, b: list[list[int]] | None) -> list[list[int]] | None:
    if a is None or b is None:
        return a or b
    return [[x + y for x, y in zip(p, q)] for p, q in zip(a, b)]


def _first_ones(dims: int, scale: int, count: int, salt: str):
    """A task's vectors to one row: the ``count`` with the least digests among them, pickled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, tuple[int, ...]]] = []
        for batch, places, block in _blocks(batches, dims, scale):
            ids = batch.column(0).take(pa.array(places)).cast(pa.string()).to_pylist()
            named = [(hashlib.sha256(f"{salt}{key}".encode()).hexdigest(), i) for i, key in enumerate(ids) if key is not None]
            edge = max(sorted(named)[:count], default=("", 0))[0]
            best = sorted(best + [(d, tuple(map(int, block[i].tolist()))) for d, i in named if d <= edge])[:count]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(best)], pa.binary())], names=["best"])

    return run


def _assigned(centroids: list[tuple[int, ...]], scale: int):
    """Rows (id, vector) to (id, cluster, distance as text)."""
    dims = len(centroids[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, places, block in _blocks(batches, dims, scale):
            cluster, distance = nearest(block, centroids)
            texts = pa.array(distance, pa.int64()).cast(pa.string()) if distance.dtype != object else pa.array(list(map(str, distance.tolist())), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(cluster, pa.int32()), texts], names=[batch.schema.names[0], "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, clusters: int, dims: int, scale: int, salt: str = "1:") -> list[tuple[int, ...]]:
    """The ``clusters`` vectors of ``vectors`` (id, vector) whose id, behind ``salt``, has the least SHA-256, in that order.

    Vectors of one digest follow their components; a null id has none. Tasks
    send ``clusters`` vectors each, which a tree of tasks merges.
    """
    each = vectors.mapInArrow(_first_ones(dims, scale, clusters, salt), "best binary")
    merged = lambda a, b: sorted(a + b)[:clusters]
    return [v for _, v in each.rdd.map(lambda row: pickle.loads(row[0])).treeAggregate([], merged, merged)]


def cluster(
    df: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(id, cluster, distance) of every sound vector, written, and the final centroids.

    A vector is sound if it has exactly ``dims`` components, none null, NaN or
    infinite; others give no row. Its components become floor(``scale`` * x).
    Centroids start as ``first_centroids`` and move ``rounds`` times to the
    componentwise floor of their members' mean; empty ones stay. Sums are exact:
    each task adds up its own and sends one row of ``clusters`` * (``dims`` + 1)
    numbers, which ``treeAggregate`` combines. The distance is squared; it is
    null where it exceeds a long, the cluster being right even then.

    Null ids are clustered but never start a centroid; repeated rows count each;
    equal distances go to the smaller number; fewer vectors than ``clusters``
    give fewer centroids, an empty table no row and no centroid. Other columns
    are ignored. Every pass reads the given table anew, so nothing is held in
    memory between rounds.
    """
    vectors = df.select(F.col(id_col), F.col(vector_col).cast("array<double>"))
    centroids = first_centroids(vectors, clusters, dims, scale)
    schema = schema_of(df, id_col, "cluster int, distance long")
    if not centroids:
        return df.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        each = vectors.mapInArrow(_sums(centroids, scale), "sums binary")
        sums = each.rdd.map(lambda row: pickle.loads(row[0])).treeAggregate(None, _added, _added)
        centroids = [tuple(v // total[0] for v in total[1:]) if total[0] else old for old, total in zip(centroids, sums)]
    found = vectors.mapInArrow(_assigned(centroids, scale), schema_of(df, id_col, "cluster int, distance string"))
    return Table(found.withColumn("distance", F.expr("try_cast(distance AS long)")), "assigned").df, centroids


def with_inertia(assigned: DataFrame, centroids: list[tuple[int, ...]]) -> DataFrame:
    """Adds cluster_inertia and inertia, the distances summed over the cluster and over all, and the digest of the cluster's centroid.

    Sums that exceed a long, or hold a distance that does, are null; an empty
    table gives no row. The sums come to the driver, a row for each centroid.
    """
    each = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: r.own for r in assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), each).alias("own")).collect()}
    fits = lambda n: None if n is None or n >= 1 << 63 else int(n)
    every = None if None in sums.values() else sum(sums.values())
    rows = [(i, fits(sums[i]), fits(every), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in sums]
    table = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster")


def _sql(clusters: int, rounds: int, dims: int) -> str:
    """DuckDB SQL of the query: rounds unrolled, sums of whole numbers."""
    nearest = lambda n: f"""
near{n} AS (
  SELECT row, arg_min(number, (d, number)) AS cluster, min(d) AS distance FROM (
    SELECT row, number, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM kept, cent{n}) GROUP BY row)"""  # noqa: E731
    parts = [
        f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""
cent0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS number, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT {clusters})""",
    ]
    for n in range(rounds):
        parts += [
            nearest(n),
            f"""
moved{n} AS (
  SELECT cluster, list(m ORDER BY i) AS c FROM (
    SELECT cluster, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (
      SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM near{n} JOIN kept USING (row), (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY cluster, i)) GROUP BY cluster),
cent{n + 1} AS (SELECT number, COALESCE(moved{n}.c, cent{n}.c) AS c FROM cent{n} LEFT JOIN moved{n} ON cluster = number)""",
        ]
    last = f"""
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds} JOIN kept USING (row) JOIN cent{rounds} ON number = cluster"""
    return ",".join([*parts, nearest(rounds)]) + last


CLUSTERED_SQL = _sql(16, 3, 64)
