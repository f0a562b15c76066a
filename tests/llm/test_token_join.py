import pytest
import sentencepiece
from pyspark.sql import functions as F

from kiteloom.llm import queries, tokencount

from .conftest import by_id

FILE = queries.vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.mark.parametrize("most", [1 << 20, 25, 1])
def test_join_against_the_library(spark, docs, odd_docs, most):
    """Below the bound all counts are broadcast; above it the rarer ones are joined by a shuffle."""
    found = by_id(tokencount.token_counts(docs, FILE, most=most))
    rows = docs.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert (found[r.doc_id].n_bytes, found[r.doc_id].n_tokens) == (len((r.text or "").encode()), len(LIBRARY.encode(r.text or "")))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in tokencount.token_counts(odd_docs, FILE, most=most).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, len(LIBRARY.encode(r.text or ""))) for r in odd_docs.collect())


def test_every_pretoken_is_counted_once(spark, docs):
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    table, salt = tokencount.piece_table(texts, FILE)
    expected = {p for r in texts.collect() for p in tokencount.pretokens(r.text)}
    rows = table.collect()
    assert {r.key % (1 << 64) for r in rows} == {tokencount.key_of(p, salt) for p in expected} and len(rows) == len(expected)


def test_keys_that_clash_are_salted_anew(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "key_of", lambda part, salt: len(part) if not salt else hash((part, 1)) >> 1)
    parts = [(7, "a"), (7, "b"), (7, "b"), (9, "c")]
    out = [b for b in tokencount._counted(FILE)(spark.createDataFrame(parts, "key long, part string").toArrow().to_batches())]
    assert [(r["key"], r["seen"], r["clash"]) for b in out for r in b.to_pylist()] == [(7, 3, True), (9, 1, False)]


def test_short_names_of_pretokens():
    from collections import Counter

    for text in ("", " ", "a", "a b a", " a b", "a  b", "a ", "a\u2581b", "\u2581a b", "\u2581", "  \u2581 ", "a\n b"):
        named = Counter()
        for short, n in tokencount.frequencies(text).items():
            named[tokencount.spelt_out(short)] += n
        assert named == Counter(tokencount.pretokens(text)), text


def test_the_commonest_are_bounded(spark):
    table = spark.createDataFrame([(i, 1, 1 + i % 40) for i in range(400)], "key long, pieces long, seen long")
    for most in (0, 5, 60, 399, 400, 1000):
        least = tokencount.commonest(table, most)
        assert table.where(f"seen >= {least}").count() <= most
    assert tokencount.commonest(table, 400) == 1


def test_other_ids_and_long_texts(spark):
    rows = [("x", "word " * 200_000), ("y", "a" * 300_000), ("y", " " * 1_000_000), ("z", "漢字" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("n", F.lit(2))
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.token_counts(df, FILE).collect())
    assert got == sorted((i, len(t.encode()), len(LIBRARY.encode(t))) for i, t in rows)
