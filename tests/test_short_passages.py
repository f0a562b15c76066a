from kiteloom.operators import split


def test_short_passages_are_found(spark):
    docs = [(1, "so 彼は東京に住んでいます。ok"), (2, "a few words here, and more of them follow"), (3, ""), (4, None), (5, "ab")]
    items = [(1, "東京に住んでいます"), (2, "few words here"), (3, "b"), (4, "not there"), (5, "words here, and more of them follow"), (6, None), (7, "")]
    found = split.contained_passages(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item long, body string"), "id", "text", "item", "body")
    expected = [(d, i) for d, t in docs for i, p in items if t is not None and p is not None and p in t]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
