from kiteloom.llm import packing, queries


def test_equal_lengths_lie_together(docs, spark):
    files = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken")
    pieces = packing.pack(docs, *files)
    rows = pieces.collect()
    by_number = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_number] == sorted(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) == len(rows) and min(r.sequence_id for r in rows) >= 0
    put = packing.gathered(pieces)
    assert sorted((r.sequence_id, r.ids) for r in put.collect()) == sorted((r.sequence_id, r.ids) for r in rows)
    for part in put.rdd.glom().collect():
        assert [r.length for r in part] == sorted(r.length for r in part)


def test_query_keeps_its_columns(spark, sf_dir):
    found = queries.op8_packing(spark, sf_dir)
    assert found.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
