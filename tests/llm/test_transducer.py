"""The transducer against the library and against merging by brute force; its lookahead; the decoder."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kiteloom.llm import queries, transducer

from .conftest import by_id

FILE, BYTES = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")


def library(text, file=FILE):
    return np.array(Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def merged(text, merges):
    """One merge after the other, the first in the list first, from the left."""
    parts = list(text)
    for a, b in merges:
        i = 0
        while i + 1 < len(parts):
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


def made_merges(rng, letters, count):
    tokens, out = list(letters), []
    while len(out) < count:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) < 12:
            tokens.append(a + b)
            out.append((a, b))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_any_merge_list(seed):
    """Random lists, unsound tokens among them: tokens as by brute force, emitted early at the computed lookahead."""
    rng = random.Random(seed)
    letters = "abc"[: rng.randint(1, 3)]
    merges = made_merges(rng, letters, rng.randint(1, 9 if len(letters) > 1 else 4))
    of = transducer.Merges(letters, merges)
    for _ in range(40):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(3))
        parts = [text[a:b] for a, b in itertools.pairwise([0, *cuts, len(text)])]
        assert list(of.tokens(parts, block=rng.choice([0, 1, 7]))) == merged(text, merges)


@pytest.mark.parametrize("seed", range(25))
def test_lookahead_suffices(seed):
    """No text of a short alphabet has an end of a token that symbols beyond the lookahead move."""
    rng = random.Random(seed)
    merges = made_merges(rng, "ab", rng.randint(1, 6))
    ahead = transducer.Merges("ab", merges).lookahead

    def ends(text):
        return set(itertools.accumulate(map(len, merged(text, merges))))

    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(ahead + 12))
        known = {e for e in ends(text) if e <= 12}
        assert all({e for e in ends(text + "".join(more)) if e <= 12} == known for more in itertools.product("ab", repeat=4))


def test_lists_that_are_refused():
    for merges in ([("a", "c")], [("ab", "a"), ("a", "b")], [("a", "b"), ("a", "b")]):
        with pytest.raises(ValueError, match="merge"):
            transducer.Merges("ab", merges)
    assert transducer.Merges("ab", []).lookahead == 0 and list(transducer.Merges("ab", []).tokens(["ab", "", "a"])) == ["a", "b", "a"]
    with pytest.raises(ValueError, match="lacks"):
        list(transducer.Merges("ab", [("a", "b")]).tokens(["abx"]))


def test_memory_is_bounded():
    """Of a long word only so many symbols are held: tokens come out while it is still being read."""
    of = transducer.tokenizer(FILE).merges
    read = 0

    def parts():
        nonlocal read
        for _ in range(60):
            read += 1000
            yield "abcde" * 200

    out = 0
    for token in of.tokens(parts(), block=2000):
        out += len(token)
        assert read - out <= 2000 + of.lookahead + 1000 + of.longest
    assert out == read == 60_000


TEXTS = [
    "Hello,  WORLD it's 12x \t\n'S 'll", "a<|endoftext|>b <|startoftext|><|EndOfText|> <|end", "ΣΑΣ ς İstanbul ß Ǆ ﬀ", "é é ẹ́ ̈́ Å", "x y z　\x85\x1c\x1f​.", "漢字かな 한국어 عربى हिन्दी", "\U0001f642\U0001f642 👩‍👩‍👧",
    "½ ² Ⅷ ٣ ª º", "\x00\x01 \x7f", "don't WE'RE x'd 've", "«quoted» — “x” … ’s", "aAbB" * 3000, "é" * 5000, "ab " * 30_000, " " * 50_000, "1" * 3000, "." * 9000, "\n", "﻿a", "a" + "́" * 400,
]


def test_texts_against_the_library():
    of, real = transducer.tokenizer(FILE), Tokenizer.from_file(FILE)
    for text in TEXTS:
        parts = list(of.encode(text))
        assert b"".join(parts) == library(text), text[:40]
        ids = np.frombuffer(b"".join(parts), "<u4").tolist()
        assert transducer._decoded(of, parts) == real.decode(ids, skip_special_tokens=False)


def test_every_plain_character_against_the_library():
    """All characters that don't go through the library's own parts, alone, doubled, and beside letters, digits and marks."""
    of, real = transducer.tokenizer(FILE), Tokenizer.from_file(FILE)
    plain = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]]
    texts = [x for c in plain for x in (c, c + c, f"a{c}b", f"1{c}2", f".{c}!", f"É{c}é", f"'{c}s")]
    want = [e.ids for e in real.encode_batch(texts, add_special_tokens=False)]
    for text, ids in zip(texts, want):
        assert np.frombuffer(b"".join(of.encode(text)), "<u4").tolist() == ids, repr(text)


def test_random_texts_of_a_byte_level_vocabulary():
    of, real = transducer.tokenizer(BYTES), Tokenizer.from_file(BYTES)
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice(["the ", "ing", "é", " ", "\n", "12", "漢", "'s", "a", "<|endoftext|>", "́"]) for _ in range(rng.randint(0, 40)))
        assert b"".join(of.encode(text)) == library(text, BYTES)
    for _ in range(300):  # any ids, whose bytes may break characters
        ids = [rng.choice([rng.randrange(50_257), rng.randrange(256)]) for _ in range(rng.randint(0, 12))]
        cut = rng.randint(0, len(ids))
        parts = [np.array(x, "<u4").tobytes() for x in (ids[:cut], ids[cut:])]
        assert transducer._decoded(of, parts) == real.decode(ids, skip_special_tokens=False), ids


def test_ids_that_are_not_there():
    for file in (FILE, BYTES):
        of, real = transducer.tokenizer(file), Tokenizer.from_file(file)
        for ids in ([], [99_999], [99_999, 5, 7], [5, 99_999, 7], [5, 7, 4_000_000_000]):
            assert transducer._decoded(of, [np.array(ids, "<u4").tobytes()]) == real.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, docs, odd_docs, no_docs, tmp_path):
    real = Tokenizer.from_file(FILE)
    rows = docs.collect()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = by_id(queries.op11_transducer(spark, str(tmp_path)))
    assert len(found) == len(rows)
    for r in rows:
        ids = real.encode(r.text or "", add_special_tokens=False).ids
        got = found[r.doc_id]
        assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(real.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert transducer.round_trip(no_docs, FILE).count() == 0
    odd = transducer.encode(odd_docs, FILE)
    assert odd.columns == ["doc_id", "n_tokens", "ids"]
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in odd.collect()) == sorted((repr(r.doc_id), library(r.text or "")) for r in odd_docs.collect())
    back = {bytes(i.ids): i for i in odd.collect()}
    decoded = transducer.decode(odd.union(spark.createDataFrame([(9, 0, None)], odd.schema)).withColumn("decoded", F.lit("clash")), FILE).collect()
    assert sorted(r.decoded for r in decoded) == sorted([real.decode(np.frombuffer(b, "<u4").tolist(), skip_special_tokens=False) for b in back for _ in range(sum(bytes(x.ids) == b for x in odd.collect()))] + [""])
