"""Quantiles by selection against sorting: ties, wild ranges, NaN, nulls, few and many values left."""

import math
import random

import numpy as np
import pytest

from kiteloom.operators import quantiles, summary


def columns(seed):
    rng = random.Random(seed)
    n = 3000
    return {
        "even": [rng.random() for _ in range(n)],
        "wild": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "ties": [float(rng.choice([0, 0, 0, 0, 1, 7])) for _ in range(n)],
        "same": [2.5] * n,
        "odd": [rng.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, rng.gauss(0, 1)]) for _ in range(n)],
        "none": [None] * n,
    }


@pytest.fixture(scope="module")
def table(spark):
    given = columns(1)
    df = spark.createDataFrame(list(zip(*given.values())), ", ".join(f"{c} double" for c in given)).repartition(4).cache()
    yield given, df
    df.unpersist()


def ordered(values):
    return sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))


@pytest.mark.parametrize("most, accuracy", [(1 << 14, 10_000), (40, 50), (1, 10)])
def test_ranks_equal_sorting(table, most, accuracy):
    given, df = table
    for c in ("even", "wild", "ties", "same", "odd"):
        values = ordered(given[c])
        ranks = [0, 1, len(values) // 3, len(values) // 2, len(values) - 2, len(values) - 1]
        got = quantiles.selected(df, [(c, r) for r in ranks], most, accuracy)
        assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got, (values[r] for r in ranks))), c


def test_interpolated_and_empty(table):
    given, df = table
    got = quantiles.exact_quantiles(df, ["even", "ties", "none"], [0.0, 0.25, 0.5, 0.999, 1.0], most=100)
    assert got["none"] is None
    for c in ("even", "ties"):
        assert np.allclose(got[c], np.quantile(given[c], [0.0, 0.25, 0.5, 0.999, 1.0]), rtol=1e-12)
    with pytest.raises(ValueError, match="rank"):
        quantiles.selected(df, [("none", 0)])


def test_summaries_of_many_rows_equal_those_of_few(table):
    _, df = table
    few, many = (sorted(map(repr, summary.numeric_summary(df, "even", "ties", "same", "none", most=most).collect())) for most in (1 << 20, 10))
    assert few == many
