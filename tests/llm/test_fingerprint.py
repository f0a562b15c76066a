import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from kiteloom.llm import fingerprint

from .conftest import by_id


def canon(text):
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    return re.sub(r"\s+", " ", nfkc(nfkc(text).casefold())).strip()


def test_canonical_text(spark):
    texts = ["Ａbc  Straße ﬁ é", "ABC\t X y ", "", "é É", "İıſK", "ẛ̣", "a b c", "\U0001d400", "ΑΣς", "plain"]
    rows = fingerprint.canonical(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "c").collect()
    assert [r.c for r in rows] == [canon(r.text) for r in rows]


def test_against_plain_edits(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()))
    found = by_id(fingerprint.fingerprints(docs))
    by_text = {}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        got = found[key]
        assert (got.n_chars, got.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got.near_edited == float(canon(edited) == canon(text))
        assert got.near_next == float(canon(after) == canon(text))
        assert (got.fingerprint == got.edited_fingerprint) == (canon(edited) == canon(text))
        assert by_text.setdefault(canon(text), got.fingerprint) == got.fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_ranges_find_the_next_row(spark):
    ids = [i * i % 1009 * 7 - 900 for i in range(300)]
    df = spark.createDataFrame([(i, f"t{i}", "d") for i in set(ids)], "doc_id long, text string, digest string").repartition(5)
    order = sorted(set(ids))
    for each in (7, 50, 10_000):
        rows = fingerprint.with_next(df, "doc_id", "text", rows_each=each).collect()
        assert sorted(r.doc_id for r in rows) == order
        assert {r.doc_id: r.next_text for r in rows} == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_equal_digests_of_unequal_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_digest", lambda c: F.lit("same"))
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "B "), (4, "c")], "doc_id long, text string")
    found = by_id(fingerprint.fingerprints(df))
    assert {k: r.fingerprint for k, r in found.items()} == {1: "same-2", 2: "same", 3: "same-2", 4: "same-3"}
    assert [found[k].near_next for k in (1, 2, 3, 4)] == [0.0, 0.0, 0.0, 0.0]


def test_odd_rows(odd_docs, no_docs, spark):
    assert fingerprint.fingerprints(no_docs).count() == 0
    assert fingerprint.fingerprints(odd_docs).count() == 7
    alone = spark.createDataFrame([(4, "Some text")], "doc_id long, text string")
    assert fingerprint.fingerprints(alone).first().near_next == 1.0
