"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kiteloom.llm import alignment, queries
from kiteloom.llm.transducer import byte_names

A, RANKS, B = map(queries.vocabulary, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
REAL_A, REAL_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
REAL_A.encode_special_tokens = True
NAMES = {c: b for b, c in enumerate(byte_names())}
VOCAB = {i: bytes(NAMES[c] for c in t) for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}


def sides(text):
    """(id, bytes) of both sides, or none."""
    a = [(i, VOCAB[i]) for i in REAL_A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in REAL_B.encode(text):
        piece = REAL_B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if REAL_B.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if text and all(b"".join(x for _, x in side) == whole for side in (a, b)) else ([], [])


def spans(side):
    out, at = [], 0
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(texts):
    """Every row's columns, by comparing each token of A with those of B beside it."""
    each = []
    for text in texts:
        a, b = map(spans, sides(text or ""))
        common = {e for _, _, e in a} & {e for _, _, e in b}
        cut = [[[]], [[]]]
        for own, side in zip(cut, (a, b)):
            for i, _, e in side:
                own[-1].append(str(i))
                if e in common:
                    own.append([])
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*cut) if x]
        links, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        each.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(x for _, _, _, links, _ in each for x in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(na, nb, ng, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest) for na, nb, ng, links, digest in each]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["Hello  world", "a<|endoftext|>b </s><s> <unk> <0x41>", "mark ▁ inside", "▁", "漢字かな 한국어", "\U0001f642 x", " ", "  two", "end ", "a\n\n b\t c", "\x00", "é́", "don't", "ﬀ ½ …", "<unk>", "　x\xa0y"]


def rows_of(df, key="doc_id"):
    return sorted((repr(r[key]), *(r[c] for c in COLUMNS)) for r in df.collect())


@pytest.mark.parametrize("most", [1 << 20, 40, 1])
def test_against_plain_loops(spark, docs, most):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(2000 + i, t) for i, t in enumerate(ODD)]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("keys", F.lit("clash")).withColumn("row", F.lit(1))
    want = sorted((repr(i), *x) for (i, _), x in zip(rows, plain([t for _, t in rows])))
    assert rows_of(alignment.align(given, A, B, RANKS, most=most)) == want
    assert any(x[-1] == "" for x in want) and sum(x[4] for x in want) > sum(x[5] for x in want) > 0


def test_odd_and_no_rows(spark, odd_docs, no_docs):
    given = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(alignment.align(odd_docs, A, B)) == sorted((repr(i), *x) for (i, _), x in zip(given, plain([t for _, t in given])))
    assert alignment.align(no_docs, A, B, RANKS).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert {r[1:] for r in rows_of(alignment.align(nothing, A, B, RANKS))} == {(0, 0, 0, 0, 0, 0, "")}


def test_parts_of_long_texts(monkeypatch):
    """However a text is cut and put into blocks, its tokens, links and digest are those of the whole."""
    of = alignment.pair(A, B, RANKS)
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the ", "wor", "ld ", " ", "\n", "12", "漢", "'s ", "é", "▁" if k == 5 else "x"]) for _ in range(rng.randint(0, 400))) for k in range(12)]
    for text in texts:
        assert "".join(of.pieces(text, 7)) == " " + text
    pieces, whole = alignment._blocks, alignment.aligned_rows(of, texts)
    for size in (1, 9, 60, 1000):
        monkeypatch.setattr(alignment, "_blocks", lambda o, t, size=size: pieces(o, t, size))
        for x, y in zip(alignment.aligned_rows(of, texts), whole):
            assert x.counts.tolist() == y.counts.tolist() and x.digest.hexdigest() == y.digest.hexdigest() and bool(x.pairs) == bool(y.pairs)
            assert not x.pairs or all(np.array_equal(p, q) for p, q in zip(x.distinct(), y.distinct()))
    assert [x.counts.tolist() for x in whole] == [[p[0], p[1], p[2], p[3]] for p in plain(texts)]


def test_very_long_texts(spark):
    rows = [("w", "word and another. " * 100_000), ("a", "a" * 200_000), ("s", " " * 100_000), ("n", "\n x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert rows_of(alignment.align(df, A, B, RANKS)) == sorted((repr(i), *x) for (i, _), x in zip(rows, plain([t for _, t in rows])))


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_alignment(spark, str(tmp_path))
    assert found.columns == ["doc_id", *COLUMNS] and {t for c, t in found.dtypes if c != "groups_sha256"} == {"bigint"}
    given = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(found) == sorted((repr(i), *x) for (i, _), x in zip(given, plain([t for _, t in given])))
