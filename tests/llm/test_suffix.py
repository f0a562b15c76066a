import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kiteloom.llm import suffix

from .conftest import by_id


def plain(texts: list[bytes], length: int) -> list[tuple]:
    places = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if places[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [1, 2, 4, 250])
@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 5, 7, 30, 31, 32, 500])
def test_suffix_array(size, letters):
    rng = random.Random(size * 1000 + letters)
    s = [rng.randint(1, letters) for _ in range(size)]
    assert suffix.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(size), key=lambda i: s[i:])


def test_windows_of_spans_are_all_windows():
    rng = random.Random(4)
    text = bytes(rng.choice(b"ab") for _ in range(3000)) + b"a" * 500
    anchor, span, first, count = suffix.spans_of(np.frombuffer(text, np.uint8), 100)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(text) - 99
    seen = {}
    for a, f, n in zip(anchor, first, count):
        for i in range(f, f + n):
            assert seen.setdefault(text[i : i + 100], a) == a  # equal windows, equal anchors
    content = {}
    for a, s, f, n in zip(anchor, span, first, count):
        assert content.setdefault((a, s), text[f : f + n + 99]) == text[f : f + n + 99]


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(9)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(700)).decode()
    made = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n)).decode()
    texts = [made(400) + passage + made(rng.randint(0, 300)) for _ in range(6)]
    texts += [made(300) + passage[100:320] + made(50), passage[:199], passage[:200], passage[300:501], made(900), made(900)]
    texts += [texts[0], "é" * 150, "é" * 250 + made(20), "a" * 1000, made(50) + "xyz" * 120, "", "short", texts[3].replace("a", "b", 1)]
    twice = made(220)
    return [*texts, twice + made(10) + twice]


@pytest.mark.parametrize("limit", [20_000, 1])
def test_against_counted_windows(spark, repeats, limit):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(repeats)], "doc_id long, text string, anchor string").repartition(4)
    found = by_id(suffix.remove_repeats(df, 200, group_limit=limit))
    expected = plain([t.encode() for t in repeats], 200)
    assert [tuple(found[i])[1:] for i in range(len(repeats))] == expected


def test_copies_of_made_documents(docs):
    rows = docs.collect()
    found = by_id(suffix.remove_repeats(docs, 64))
    expected = plain([(r.text or "").encode() for r in rows], 64)
    assert [tuple(found[r.doc_id])[1:] for r in rows] == expected


def test_odd_rows(odd_docs, no_docs):
    assert suffix.remove_repeats(no_docs).count() == 0
    rows = suffix.remove_repeats(odd_docs, 64).collect()
    assert len(rows) == 7
    assert sorted(tuple(r)[1:] for r in rows) == sorted(plain([(r.text or "").encode() for r in odd_docs.collect()], 64))
    with pytest.raises(ValueError):
        suffix.remove_repeats(no_docs, 40)
