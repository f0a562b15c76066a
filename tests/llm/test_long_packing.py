import time

from kiteloom.llm import packing, queries


def test_long_white_space_and_one_letter():
    """The faster library fails on such runs of spaces; the result is that of ``tokenizers`` all the same."""
    files = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken")
    both, slow = packing.encoder(*files), packing.encoder(files[0], None)
    for text in (" " * 2_000_000 + "x", "\n" * 1_200_000, "x" + "\t" * 1_200_000 + " y"):
        assert (both.encode(text) == slow.encode(text)).all()
    began = time.monotonic()
    assert len(both.encode("a" * 5_000_000)) == len(slow.encode("a" * 5_000_000))
    assert time.monotonic() - began < 60


def test_documents_with_long_white_space(spark):
    rows = [(1, " " * 2_000_000 + "x"), (2, "plain"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(df, queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken")).collect()
    for doc, text in rows:
        own = [p for p in pieces if p.doc_id == doc]
        assert {p.doc_tokens for p in own} == {sum(p.length for p in own)}
        assert sorted(p.start for p in own) == [sum(p.length for p in own[:i]) for i in range(len(own))]
        ids = b"".join(p.ids for p in own)
        assert ids[:-4] == packing.encoder(queries.vocabulary("byte_bpe_50k.json"), None).encode(text or "").tobytes()
