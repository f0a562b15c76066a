import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kiteloom.llm import simhash
from kiteloom.llm.components import components

from .conftest import by_id


def plain(text: str) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_against_all_pairs(docs):
    rows = {r.doc_id: plain(r.text) for r in docs.collect()}
    expected = groups(rows, [(a, b) for a in rows for b in rows if a < b and (rows[a] ^ rows[b]).bit_count() <= 2])
    found = by_id(simhash.near_duplicates(docs))
    assert {k: int(r.fingerprint, 16) for k, r in found.items()} == rows
    assert {k: r.component_id for k, r in found.items()} == expected
    assert any(k != v for k, v in expected.items())


def close_fingerprints(count: int, seed: int) -> list[int]:
    rng, out = random.Random(seed), set()
    while len(out) < count:
        base = rng.choice(sorted(out)) if out and rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            base ^= 1 << rng.randrange(64)
        out.add(base)
    return sorted(out)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_trie_join_finds_every_link(spark):
    values = close_fingerprints(400, 1)
    expected = groups(values, [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2])
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for limit in (1 << 16, 3):  # the second lays every larger trie out again
        links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.trie_links(fps, trie_limit=limit).collect()]
        assert groups(values, links) == expected
        assert len(links) <= 6 * 6 * len(values)


def test_traversal_prunes_to_the_budget():
    keys = np.array(sorted(random.Random(2).sample(range(1 << 12), 300)), np.uint64)
    labels = np.arange(len(keys))
    simhash._join_nodes(keys, labels, 1, 12)
    expected = groups(range(300), [(i, j) for i in range(300) for j in range(i + 1, 300) if (int(keys[i]) ^ int(keys[j])).bit_count() <= 1])
    assert labels.tolist() == [expected[i] for i in range(300)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    found = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)}


def test_odd_rows(odd_docs, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 7
    assert sum(r.doc_id == 5 and r.component_id == 5 for r in rows) == 2
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {8}


def test_one_of_each(docs, odd_docs, no_docs):
    found = by_id(simhash.near_duplicates(docs))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found.values()})
    assert simhash.one_of_each(no_docs).count() == 0
    assert sorted(r.doc_id for r in simhash.one_of_each(odd_docs).where(F.col("doc_id").isNotNull()).collect()) == [5, 7, 7, 8]
