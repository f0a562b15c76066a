import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kiteloom.llm import mixing

from .conftest import by_id


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), {s for s in names if sizes[s]}
    while left > 1e-6 and open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_against_a_plain_mix(docs):
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    target = plain_targets(sizes)
    found = by_id(mixing.taken(mixing.mix(docs)))
    for source in sizes:
        order = sorted((r for r in rows if r.source == source), key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest())
        budget, at, taken = int(target[source] + 0.5), 0, {}
        for _ in range(2):
            for r in order:
                n = words(r.text)
                taken[r.doc_id] = taken.get(r.doc_id, 0) + max(0, min(n, budget - at))
                at += n
        for r in order:
            got = found[r.doc_id]
            assert (got.size, got.source_size, got.taken) == (words(r.text), sizes[source], taken[r.doc_id])
            assert got.target == pytest.approx(target[source])
            assert got.taken <= 2 * got.size
        assert sum(taken.values()) == budget


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1000}, {"a": 1}, {"a": 0, "b": 5, None: 7}, {"a": 1, "b": 1, "c": 1, "d": 10_000}, {s: 3 ** i for i, s in enumerate("abcdefgh")}])
def test_targets_by_refilling(spark, sizes):
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert found == pytest.approx(plain_targets(sizes))


def test_times_invert_the_integrated_schedule(spark):
    knots = ((0.0, 1.0), (0.25, 3.0), (0.5, 3.0), (1.0, 0.0))
    area = lambda t: sum((min(t, b) - a) * (wa + wa + (wb - wa) * (min(t, b) - a) / (b - a)) / 2 for (a, wa), (b, wb) in zip(knots, knots[1:]) if t > a)
    parts = [i / 50 for i in range(51)]
    rows = spark.createDataFrame([(p,) for p in parts], "part double").select("part", mixing.time_at(F.col("part"), mixing._segments(knots)).alias("t")).collect()
    for r in rows:
        assert area(r.t) == pytest.approx(r.part * area(1.0), abs=1e-6)


def test_early_sources_come_early(docs):
    rows = [r for r in mixing.mix(docs).collect() if r.positions[0] is not None]
    assert all(0 <= p <= 1 for r in rows for p in r.positions if p is not None)
    mean = lambda s: (lambda p: sum(p) / len(p))([x for r in rows if r.source == s for x in r.positions if x is not None])
    assert mean("s0") < mean("s1") < mean("s2")


def test_reruns_agree(docs):
    a, b = (sorted(map(tuple, mixing.taken(mixing.mix(d)).collect())) for d in (docs, docs.repartition(2)))
    assert a == b


def test_odd_rows(odd_docs, no_docs):
    assert mixing.mix(no_docs).count() == 0
    rows = mixing.taken(mixing.mix(odd_docs)).collect()
    assert len(rows) == 7 and all(r.taken <= 2 * r.size for r in rows)


def test_mixed_documents(docs, odd_docs, no_docs):
    taken = {r.doc_id: r.taken for r in mixing.taken(mixing.mix(docs)).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + words(r.text)
    assert got == {k: v for k, v in taken.items() if v}
    assert mixing.mixed_documents(no_docs).count() == 0
    total = sum(r.taken for r in mixing.taken(mixing.mix(odd_docs)).collect())
    assert sum(words(r.text) for r in mixing.mixed_documents(odd_docs).collect()) == total
