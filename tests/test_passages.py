"""Held-out passages in documents, against looking for each in each text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiteloom.operators import passages


def made(seed):
    rng = random.Random(seed)
    letters = "ab é漢\n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    docs = [(i, text(rng.choice([0, 3, 20, 90, 400]))) for i in range(60)] + [(3, text(50)), (None, text(60)), (99, None)]
    items = []
    for k in range(70):
        of = rng.choice([t for _, t in docs if t])
        at, n = rng.randrange(len(of)), rng.choice([1, 2, 5, 9, 20, 40, 200])
        items.append((k, of[at : at + n] + rng.choice(["", "", "b", "zz"])))
    return docs, items + [(100, None), (101, ""), (102, items[0][1]), (None, items[1][1]), (103, "x" * 500), (104, "x" * 31)]


def expected(docs, items):
    return sorted({(d, i) for d, t in docs for i, p in items if t is not None and p is not None and p in t}, key=repr)


def found(spark, docs, items, **settings):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("key", F.lit("clash")).withColumn("item", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, body string").withColumn("text", F.lit("clash"))
    out = passages.contained_passages(d, i, "doc_id", "text", "item_id", "body", **settings)
    assert out.columns == ["doc_id", "item_id"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("settings", [{}, {"most_keys": 20}, {"most_bytes": 900}])
def test_against_every_pair(spark, settings):
    docs, items = made(1)
    assert found(spark, docs, items, **settings) == expected(docs, items)


def test_no_rows_and_same_keys(spark):
    docs, items = made(2)
    assert found(spark, [], items) == found(spark, docs, []) == []
    same = [(1, "x" * 40), (2, "x" * 45), (3, "x" * 40 + "y")]  # one key, three passages
    assert found(spark, [(1, "a" + "x" * 44), (2, "x" * 40 + "y")], same) == [(1, 1), (2, 1), (2, 3)]


def test_hashes_are_those_of_windows():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 300).astype(np.uint8)
    for width, hashes in passages.window_hashes(raw).items():
        assert len(hashes) == 300 - width + 1
        for at in (0, 7, 300 - width):
            assert hashes[at] == passages.window_hashes(raw[at : at + width])[width][0]
    assert all(len(h) == 0 for h in passages.window_hashes(raw[:5]).values())


def test_filter_lets_little_through():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(20_000)) for _ in range(5)]
    keys = {32: np.array([passages.key_of(texts[2][500:700].encode())[1]], np.uint64)}
    rows, hit = passages.Filter(keys, []).hits(texts)
    assert rows.tolist() == [2] and hit.tolist() == keys[32].tolist()
