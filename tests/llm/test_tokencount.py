import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kiteloom.llm import queries, tokencount

from .conftest import by_id

FILE = queries.vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)


def test_query_against_the_library(spark, sf_dir):
    found = by_id(queries.op9_token_counts(spark, sf_dir))
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n = len(LIBRARY.encode(r.text or ""))
        got = found[r.doc_id]
        assert (got.n_bytes, got.n_tokens, got.over_limit) == (len((r.text or "").encode()), n, n > 4096)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list(" ▁ab<s>/\n\t　\x00é漢\U0001f642")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    assert tokencount.counter(FILE).count([text]) == [len(LIBRARY.encode(text))]


def test_a_full_cache_is_emptied():
    counter = tokencount.PieceCounter(FILE, cache=5)
    texts = ["one two three", "four five six seven", "one eight nine", "a b c d e f g h"]
    assert [counter.count([t])[0] for t in texts] == [len(LIBRARY.encode(t)) for t in texts]


def test_odd_rows(docs, odd_docs, no_docs):
    assert tokencount.token_counts(no_docs, FILE).count() == 0
    assert tokencount.token_counts(odd_docs, FILE).count() == 7
    found = by_id(tokencount.token_counts(docs, FILE))
    assert found[1000].n_tokens == 0 and found[1000].n_bytes == 0
