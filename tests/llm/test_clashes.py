"""Columns named like the operators' own, and odd rows, through what keeps all columns and through the whole pipeline."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from kiteloom.llm import mixing, neardup, secrets, simhash, toxicity

INTERNAL = "_own_hash _hash _id _mix_own _mix_id _mix_at _mix_take _mix_row _mix_n _mix_k _kept_own _kept_hash __kept_id hash id size row node n first at take digest before words keys ids score spans position _c0".split()


@pytest.fixture(scope="module")
def clashing(docs, odd_docs):
    named = docs.union(odd_docs)
    return named.select(*named.columns, *(F.lit(i).alias(c) for i, c in enumerate(INTERNAL) if c not in named.columns))


@pytest.mark.parametrize("operator", [neardup.one_of_each, simhash.one_of_each, mixing.mixed_documents, secrets.redacted])
def test_columns_keep_their_values(clashing, operator):
    out = operator(clashing)
    assert out.columns == clashing.columns
    rows = out.select([c for c in INTERNAL if c not in ("size", "words")]).distinct().collect()
    assert [r.asDict() for r in rows] == [{c: i for i, c in enumerate(INTERNAL) if c not in ("size", "words")}]


def test_toxic_filter_keeps_columns(spark, clashing):
    labels = spark.createDataFrame([(i * 3, 1, int(i % 2)) for i in range(40)], "doc_id long, quality int, toxic int")
    out = toxicity.without_toxic(clashing, toxicity.fit(*toxicity.training_rows(clashing, labels)))
    assert out.columns == clashing.columns and out.where("_own_hash <> 0 OR _hash <> 1").isEmpty()


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_on_odd_rows(spark, tmp_path, clashing, rows):
    """Null and repeated ids, a repeated id of two texts, clashing names, no rows at all."""
    (clashing if rows == "odd" else clashing.limit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i * 3, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(pieces) == (rows == "odd") and all(p.length & (p.length - 1) == 0 for p in pieces)
