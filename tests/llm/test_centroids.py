"""Clustering against plain integers, with odd vectors, huge components and ties."""

import hashlib
import random
from math import floor

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kiteloom.llm import centroids, queries


def plain(rows, clusters=16, rounds=3, dims=64, scale=64):
    """(id, cluster, distance, vector) of the sound rows, and the centroids, in Python's integers."""

    def exact(x):
        top, bottom = float(x).as_integer_ratio()
        return top * scale // bottom

    kept = [(i, tuple(exact(x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in named[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        members = [[] for _ in cents]
        for _, v in kept:
            members[near(v)[1]].append(v)
        cents = [tuple(floor(sum(x) // len(m)) for x in zip(*m)) if m else c for m, c in zip(members, cents)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept] if cents else [], cents


def made(count, dims, spread, seed):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-1, 1) * rng.choice(spread) for _ in range(dims)]) for i in range(count)]


def found(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    out, cents = centroids.cluster(df, **settings)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in out.collect()), key=repr), cents


def fitting(rows):
    return sorted(((i, c, d if d < 1 << 63 else None) for i, c, d in rows), key=repr)


@pytest.mark.parametrize("spread", [[1.0], [1.0, 1e6], [1e3, 1e15], [1.0, 1e18], [0.5, 1e300]])
def test_against_plain_integers(spark, spread):
    rows = made(120, 4, spread, 5)
    got, cents = found(spark, rows, clusters=5, dims=4)
    want, expected = plain(rows, 5, 3, 4)
    assert cents == expected and got == fitting(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(30, 4, [1.0], 6) + [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0] * 5), (104, [1.0, None, 1.0, 1.0]), (105, [nan, 0.0, 0.0, 0.0]), (106, [0.0, -inf, 0.0, 0.0])]
    rows += [(None, [0.25] * 4), (7, [0.5] * 4), (7, [0.5] * 4), (8, [-0.0] * 4)]
    got, cents = found(spark, rows, clusters=5, dims=4)
    want, expected = plain(rows, 5, 3, 4)
    assert cents == expected and got == fitting(want) and len(got) == 34


def test_ties_few_rows_and_none(spark):
    same = [(i, [0.5] * 4) for i in range(9)]
    got, cents = found(spark, same, clusters=3, dims=4)
    assert {(c, d) for _, c, d in got} == {(0, 0)} and len(cents) == 3  # the smaller number wins, the others stay
    two = made(2, 4, [1.0], 1)
    assert found(spark, two, clusters=16, dims=4)[1] == plain(two, 16, 3, 4)[1]
    assert found(spark, [], clusters=3, dims=4) == ([], []) == found(spark, [(1, None)], clusters=3, dims=4)


def test_exact_at_the_bound():
    """The product of matrices is right up to the bound it is used for, and not beyond."""
    top = int(((1 << 53) / 64) ** 0.5)
    rng = random.Random(2)
    for magnitude in (top // 2 - 1, top // 2, top, 1 << 40, 1 << 70):
        block = np.array([[rng.randint(-magnitude, magnitude) for _ in range(64)] for _ in range(20)], object)
        cents = [tuple(int(v) + rng.randint(-1, 1) for v in row) for row in block[:6]]
        given = block.astype(np.float64) if magnitude < 1 << 53 else block
        cluster, distance = centroids.nearest(given, cents)
        want = [min((sum((a - b) ** 2 for a, b in zip(map(int, row), c)), k) for k, c in enumerate(cents)) for row in block.tolist()]
        assert [(int(d), int(c)) for c, d in zip(cluster, distance)] == want


def test_inertia_of_huge_and_no_distances(spark):
    huge = [(0, [0.0] * 4), (1, [1e300] * 4), (2, [3e300] * 4), (3, [0.25] * 4)]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    rows = centroids.with_inertia(*centroids.cluster(df, clusters=2, dims=4)).collect()
    assert len(rows) == 4 and {r.inertia for r in rows} == {None} and any(r.distance is None for r in rows)
    assert centroids.with_inertia(*centroids.cluster(df.limit(0), dims=4)).count() == 0


def test_query_against_plain_and_sql(spark, sf_dir, tmp_path):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    odd = spark.createDataFrame([(5000, [1.0] * 63), (5001, None), (5002, [float("nan")] * 64), (5003, [2.0] * 64), (5003, [2.0] * 64)], "vec_id long, embedding array<float>")
    df = given.select("vec_id", "embedding").union(odd).withColumn("cluster", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op13_centroids(spark, str(tmp_path)).collect()
    want, cents = plain([(r.vec_id, r.embedding) for r in df.collect()])
    assert sorted((r.vec_id, r.cluster, r.distance) for r in rows) == sorted(want)
    sums = {k: sum(d for _, c, d in want if c == k) for k in range(16)}
    assert all((r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values())) for r in rows)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest() for r in rows)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        names = rows[0].__fields__
        sql = db.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op13_centroids']})").fetchall()
    assert sorted(sql) == sorted(tuple(r) for r in rows)
