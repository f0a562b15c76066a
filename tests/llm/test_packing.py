import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kiteloom.llm import packing, queries

from .conftest import by_id

FILE, RANKS = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def check(pieces, texts, library, longest=1024):
    seen = {}
    for p in pieces:
        seen.setdefault(p.doc_id, []).append(p)
    assert seen.keys() == texts.keys()
    for key, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(seen[key], key=lambda p: p.start)
        assert [p.start for p in own] == np.r_[0, np.cumsum([p.length for p in own])[:-1]].tolist()
        assert sum(p.length for p in own) == len(ids) and {p.doc_tokens for p in own} == {len(ids)}
        for p in own:
            assert p.length & (p.length - 1) == 0 and p.length <= longest and p.offset == 0
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert len({p.sequence_id for p in pieces}) == len(pieces)


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(queries.op8_packing(spark, sf_dir).collect(), texts, library)


def test_both_libraries_agree_on_every_plain_character(library):
    e = packing.encoder(FILE, RANKS)
    for code in (*range(1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)):
        for text in (f"a{chr(code)}b", f" {chr(code)} {chr(code)}{chr(code)}1", f"x  {chr(code)}"):
            assert e.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(code)


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "漢字 and ελ", "\U0001f642‍ x", "don't  \n\n x", "a" * 5000, "   "])
def test_hard_texts(text, library):
    assert packing.encoder(FILE, RANKS).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [1, 2, 3, 1023, 1024, 1025, 2048, 5000])
def test_powers_of_two(length):
    pieces = packing.pieces_of(length, 1024)
    assert sum(pieces) == length and pieces == sorted(pieces, reverse=True)
    assert all(p & (p - 1) == 0 for p in pieces) and len({p for p in pieces if p < 1024}) == sum(p < 1024 for p in pieces)


def test_odd_rows_and_buckets(odd_docs, no_docs, docs, spark, tmp_path):
    assert packing.pack(no_docs, FILE).count() == 0
    assert packing.pack(odd_docs, FILE, RANKS).where("start = 0").count() == 7
    with pytest.raises(ValueError):
        packing.pack(docs, FILE, longest=1000)
    packing.write_buckets(packing.pack(docs, FILE, RANKS), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("length <> pow(2, bucket)").isEmpty() and by_id(back.groupBy("bucket").count(), "bucket")
