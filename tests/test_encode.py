"""Chats through a real tokenizer: rendering, ids, masks, and prompts whose ids don't begin the whole's."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from kiteloom.functions import metrics as M
from kiteloom.operators import encode

ROWS = [(1, "say this", "yes it is"), (2, " padded\n", "\tso "), (3, "long one", "word " * 60), (4, "no answer", ""), (5, None, None)]


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    """A small byte-free BPE that joins "a" and "b", also across a border."""
    letters = sorted({c for _, p, t in ROWS for c in (p or "") + (t or "")} | set("<>_abcdefghijklmnopqrstuvwxyz\n\t |:"))
    vocab = {c: i for i, c in enumerate([*letters, "ab", "is", "it"])}
    path = str(tmp_path_factory.mktemp("vocab") / "t.json")
    Tokenizer(BPE(vocab, [("a", "b"), ("i", "s"), ("i", "t")])).save(path)
    return path


def pairs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "record_id long, prompt string, target string").repartition(2)


def test_examples_through_a_real_tokenizer(spark, file):
    own = Tokenizer.from_file(file)
    rows = {r.record_id: r for r in encode.training_examples(pairs(spark), 200, encode.from_file(file)).collect()}
    for i, prompt, target in ROWS:
        head = f"<bos><start_of_turn>user\n{(prompt or '').strip()}<end_of_turn>\n<start_of_turn>model\n"
        p, f = own.encode(head).ids, own.encode(head + (target or "").strip() + "<end_of_turn>\n").ids
        r = rows[i]
        assert (r.prompt_tokens, r.full_tokens) == (len(p), len(f))
        if len(f) > 200:
            assert r.skip_reason == "sequence_too_long" and r.input_ids is r.labels is r.supervised_tokens is None
        else:
            assert r.skip_reason is None and r.input_ids == f and r.labels == [-100] * len(p) + f[len(p) :] and r.supervised_tokens == len(f) - len(p)
    assert rows[3].skip_reason and own.encode("is it").ids != [own.token_to_id(c) for c in "is it"]


def test_a_merge_across_the_border(spark, file):
    """The prompt's last letter and the answer's first are one token of the whole: no place to begin the mask."""
    template = encode.Template(begin="", before="", after="")
    rows = [(1, "xa", "b"), (2, "xa", "c"), (3, "xa", ""), (4, "a" * 50, "b" * 50)]
    found = {r.record_id: r for r in encode.training_examples(pairs(spark, rows), 60, encode.from_file(file), template, strict=False).collect()}
    assert [found[i].skip_reason for i in (1, 2, 3, 4)] == ["prompt_not_a_prefix", None, "no_supervised_tokens", "sequence_too_long"]
    assert found[1].labels is None and found[2].labels[:2] == [-100, -100] and len(found[2].labels) == 3
    with pytest.raises(Exception, match="don't begin the whole sequence's: 1"):
        encode.training_examples(pairs(spark, rows), 60, encode.from_file(file), template).collect()


def test_prompts_and_encoders_by_name(spark, file):
    asked = {r.record_id: r.input_ids for r in encode.encoded_prompts(pairs(spark), "kiteloom.operators.encode:code_points").collect()}
    assert "".join(map(chr, asked[1])) == "<bos><start_of_turn>user\nsay this<end_of_turn>\n<start_of_turn>model\n"
    made = encode.encoded_prompts(pairs(spark), f"kiteloom.operators.encode:from_file:{file}")
    assert {r.record_id: r.input_ids for r in made.collect()}[1] == Tokenizer.from_file(file).encode("".join(map(chr, asked[1]))).ids
    for wrong in ("encode", "kiteloom.operators.encode:", "kiteloom.operators.encode:TOO_LONG"):
        with pytest.raises(ValueError, match="function"):
            encode.named(wrong)
    with pytest.raises(Exception, match="gave 0 sequences"):
        encode.encoded_prompts(pairs(spark), lambda: lambda texts: []).collect()
    assert encode.training_examples(pairs(spark).limit(0), 10).count() == 0


def test_marks_apart_in_the_jvm(spark):
    texts = ["It's 3.5, \"so\" (yes) 10-15 a&amp;b.", "x-\ny <skipped>&quot;q&quot;\nz", "1,000.5.", "..,,", "a.b 1.b b.1 5- -5", "[{~}] `\\^_", "漢字。é!　x\xa0y", "", " ", "$1 \\1 €"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", M.bleu_words(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r.w.split(" ") if r.w else [] for r in found] == [M.bleu_tokens(t) for t in texts]
