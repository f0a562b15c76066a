"""The tree's draws against SQL, its distribution, sums against the weights, and the deal of many groups in one stream."""

import hashlib

import duckdb
import numpy as np
import pytest

from kiteloom.operators import evaluate, resample, split


def weights(places, samples, seed, leaf):
    tree = resample.Tree(places, samples, seed, leaf)
    return np.concatenate([tree.weights(b) for b in range(tree.blocks)], axis=1)


@pytest.mark.parametrize("places, leaf, depth", [(250, 64, 3), (333, 10, 6), (5, 2, 3), (1, 4, 1), (64, 64, 0)])
def test_draws_equal_sql(places, leaf, depth):
    own = weights(places, 30, 7, leaf)
    assert own.shape == (30, places) and (own.sum(axis=1) == places).all()
    sql = f"WITH {resample.weights_sql(str(places), 30, 7, leaf, depth)} SELECT replicate, place, w FROM weights"
    found = np.zeros_like(own)
    for replicate, place, w in duckdb.sql(sql).fetchall():
        found[replicate, place] = w
    assert (found == own).all()


def test_any_order_of_blocks_draws_alike():
    tree, other = resample.Tree(1000, 8, 3, 16), resample.Tree(1000, 8, 3, 16)
    forth = {b: tree.weights(b) for b in range(tree.blocks)}
    for b in np.random.default_rng(2).permutation(tree.blocks).tolist():
        assert (other.weights(b) == forth[b]).all()
    assert not (resample.Tree(1000, 8, 4, 16).weights(0) == forth[0]).all()


def test_distribution():
    """Counts of a place have mean 1 and variance 1 - 1/n; those of two places go together by -1/n; halves are binomial."""
    own = weights(60, 4000, 5, 8).astype(float)
    assert abs(own.mean(axis=0) - 1).max() < 0.08 and abs(own.var(axis=0) - (1 - 1 / 60)).max() < 0.12
    covariance = np.cov(own.T)
    assert abs(covariance[~np.eye(60, dtype=bool)].mean() + 1 / 60) < 0.003
    half = own[:, :30].sum(axis=1)
    assert abs(half.mean() - 30) < 0.3 and abs(half.var() - 15) < 1.2


def test_binomial_against_counted_probabilities():
    from math import comb

    rng = np.random.default_rng(4)
    for trials, share in ((1, 0.5), (7, 0.1), (60, 0.9), (300, 0.37)):
        sums = np.cumsum([comb(trials, k) * share**k * (1 - share) ** (trials - k) for k in range(trials + 1)])
        u = rng.random(500)
        assert (resample.binomial(u, np.full(500, trials), share) == (sums[None, :] <= u[:, None]).sum(axis=1)).all()
    assert resample.binomial(np.array([0.3, 0.9]), np.array([0, 5]), 1.0).tolist() == [0, 5]
    big = resample.binomial(rng.random(300), np.full(300, 10**9), 0.5)
    assert abs(big.mean() - 5e8) < 5 * np.sqrt(2.5e8 / 300)


def test_sums_in_any_partitions(spark):
    own, rng = weights(300, 12, 9, 32), np.random.default_rng(3)
    stats = rng.integers(0, 50, (300, 4))
    rows = [(i, s[:3].tolist(), [int(s[3]) << 45]) for i, s in enumerate(stats)]
    df = spark.createDataFrame(rows, "place long, x array<long>, y array<long>")
    for parts in (1, 7):
        got = resample.replicate_sums(df.repartition(parts), {"x": 3, "y": 1}, 300, 12, 9, 32).orderBy("replicate").collect()
        assert [r.x for r in got] == (own @ stats[:, :3]).tolist()
        assert [r.y[0] for r in got] == [int(v) << 45 for v in own @ stats[:, 3]]
    assert resample.replicate_sums(df.limit(0), {"x": 3, "y": 1}, 300, 12, 9, 32).count() == 0


def test_replicates_and_significance(spark):
    rows = [(f"r{i:03d}", s, f"w{i} x{i} y", f"w{i} x{i} " + ("y" if s == "b" or i % 3 else "z"), "q") for i in range(40) for s in "ab"]
    stats = evaluate.scored(spark.createDataFrame(rows, "record_id string, system string, target string, prediction string, source string")).cache()
    deltas = [r.delta for r in evaluate.tree_replicates(stats, "a", "b", 60, 1, leaf=8).collect()]
    assert len(deltas) == 60 and min(deltas) >= 0 and len(set(deltas)) > 10
    found = evaluate.significance(stats, "a", "b", 60, 1, evaluate.tree_replicates).first()
    assert found.samples == 60 and found.ci95_low <= found.observed_delta <= found.ci95_high
    assert evaluate.tree_replicates(stats, "a", "none", 60, 1).count() == 0 == evaluate.tree_replicates(stats, "a", "b", 0, 1).count()
    stats.unpersist()


def test_many_groups_in_one_stream(spark):
    """Far more groups than the old limit, each dealt as a plain loop over the sorted digests deals it."""
    count = 120_000
    sizes = spark.range(count).selectExpr("concat('g', id) AS group_id", "1 + id * 7919 % 13 AS n")
    found = dict(tuple(r) for r in split.folded_by_hash(sizes, seed=3).toLocalIterator())
    order = sorted((hashlib.md5(f"3:g{i}".encode()).hexdigest(), f"g{i}", 1 + i * 7919 % 13) for i in range(count))
    total = sum(n for _, _, n in order)
    have = dict.fromkeys(split.RATIOS, 0)
    for _, g, n in order:
        best = max(split.RATIOS, key=lambda s: (total * split.RATIOS[s] - have[s]) / (total * split.RATIOS[s]))
        have[best] += n
        assert found.pop(g) == best
    assert not found


def test_groups_of_other_types_and_none(spark):
    pairs = spark.createDataFrame([(i, i % 5 if i % 7 else None, "s", "t") for i in range(60)], "record_id int, group_id int, source string, target string")
    rows = split.split_groups(pairs, rng="hash").collect()
    assert {type(r.group_id) for r in rows} == {int} and len({(r.group_id, r.split) for r in rows}) == 5
    with pytest.raises(ValueError, match="groups are needed"):
        split.split_groups(pairs.limit(0), rng="hash")
