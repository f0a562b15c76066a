import unicodedata

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kiteloom.functions import arrays as A
from kiteloom.functions import metrics as M
from kiteloom.functions import text as X


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def evaluate(spark, values, expression, kind="string"):
    rows = column(spark, list(enumerate(values)), f"struct<i: int, v: {kind}>").select("x.i", F.col("x.v").alias("x")).select("i", expression.alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def plain_normalize(text):
    text = unicodedata.normalize("NFC", text or "")
    return " ".join("".join(c for c in text if c not in "​‌‍⁠﻿").split())


TEXTS = ["  भा​षा   शब्द  ", None, "", "NA", "é ä", " a\x1c\x1db\x85c ", "﻿mark", "क़ ड़"]


def test_normalize(spark):
    assert evaluate(spark, TEXTS, X.normalize(F.col("x"))) == [plain_normalize(t) for t in TEXTS]
    assert evaluate(spark, ["  भाषा   शब्द​  "], X.normalize(F.col("x"))) == ["भाषा शब्द"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_white_space_is_pythons(spark, texts):
    assert evaluate(spark, texts, X.metric_text(F.col("x"))) == [" ".join(t.split()) for t in texts]
    assert evaluate(spark, texts, X.word_count(F.col("x"))) == [len(t.split()) for t in texts]


def test_script_ratio(spark):
    values = ["भाषा शब्द १२ !", "latin words", "", "123", "भा ab", "ꣲ𑬀", None]
    assert evaluate(spark, values, X.script_ratio(F.col("x"))) == [1.0, 0.0, 0.0, 0.0, pytest.approx(1 / 3), 1.0, None]
    assert evaluate(spark, ["abé"], X.script_ratio(F.col("x"), X.ASCII)) == [pytest.approx(2 / 3)]


def test_counts_and_ratios(spark):
    assert evaluate(spark, ["a1!", "", "é¼ x"], X.content_chars(F.col("x"))) == [2, 0, 3]
    assert evaluate(spark, ["abcd", ""], X.length_ratio(F.col("x"), F.lit(""))) == [4.0, 0.0]


def test_length_buckets(spark):
    assert evaluate(spark, [1, 5, 6, 10, 11, 20, 21, 40, 0], X.length_bucket(F.col("x")), "int") == ["1-5", "1-5", "6-10", "6-10", "11-20", "11-20", "21+", "21+", "0"]


def test_prompts(spark):
    assert evaluate(spark, ["  hello "], X.prompt(F.col("x"), " German ")) == ["Translate the following text into German:\n\nhello"]
    for text, language in (("  ", "German"), ("x", " ")):
        with pytest.raises(Exception, match="empty"):
            evaluate(spark, [text], X.prompt(F.col("x"), language))
    (m,) = evaluate(spark, ["q"], X.messages(F.col("x"), F.lit("a")))
    assert [(t.role, t.content) for t in m] == [("user", "q"), ("assistant", "a")]


def test_names(spark):
    fragments = X.ordered_distinct(F.array(F.lit("Vision"), F.lit("audio")), F.array(F.lit("vision"), F.lit("Head")))
    assert evaluate(spark, ["x"], fragments) == [["vision", "audio", "head"]]
    assert evaluate(spark, ["a.VISION.b", "lm_head", "q_proj"], X.contains_any(F.col("x"), fragments)) == [True, True, False]
    assert evaluate(spark, ["a.b.c", "c"], X.last_segment(F.col("x"))) == ["c", "c"]
    assert evaluate(spark, ["checkpoint-25", "other"], X.capture(F.col("x"), "^checkpoint-(\\d+)$")) == ["25", None]
    assert X.check_system_name("tuned_700-a") and X.check_run_id(" v1.2-x ") == "v1.2-x"
    for bad, check in (("a b", X.check_system_name), ("", X.check_system_name), ("a/b", X.check_run_id), (" ", X.check_run_id)):
        with pytest.raises(ValueError):
            check(bad)


def test_escapes_and_formats(spark):
    assert evaluate(spark, ['<a href="x">&'], X.escape_html(F.col("x"))) == ["&lt;a href=&quot;x&quot;&gt;&amp;"]
    assert evaluate(spark, ["</script>"], X.escape_script(F.col("x"))) == ["<\\/script>"]
    assert evaluate(spark, [1.236], X.fixed(F.col("x")), "double") == ["1.24"]
    assert evaluate(spark, [0.5], X.percent(F.col("x")), "double") == ["50.0%"]
    assert evaluate(spark, [2.0, -1.0], X.signed(F.col("x")), "double") == ["+2.00", "-1.00"]
    assert evaluate(spark, ["Abc", "x"], X.search([F.col("x")], "aB")) == [True, False]


# Arrays


def ints(*values):
    return F.array(*map(F.lit, values))


def one(spark, expression):
    return spark.range(1).select(expression.alias("y")).first().y


def test_label_mask(spark):
    assert one(spark, A.label_mask(ints(2, 10, 11, 12), ints(2, 10, 11, 12, 50, 51, 1))) == [-100] * 4 + [50, 51, 1]
    for prompt, full in ((ints(2, 3), ints(2, 4, 5)), (ints(2, 3), ints(2, 3)), (ints(2, 3), ints(2))):
        with pytest.raises(Exception, match="proper beginning"):
            one(spark, A.label_mask(prompt, full))


def test_padding(spark):
    rows = [(1, [5, 6], [1, 1], [-100, 6]), (1, [5, 6, 7], [1, 1, 1], [-100, 6, 7]), (2, [9], [1], [9])]
    df = spark.createDataFrame(rows, "b int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    right = sorted(map(tuple, A.pad_batches(df, "b").collect()))
    assert right == [(1, [5, 6, 0], [1, 1, 0], [-100, 6, -100]), (1, [5, 6, 7], [1, 1, 1], [-100, 6, 7]), (2, [9], [1], [9])]
    left = sorted(map(tuple, A.pad_batches(df, "b", side="left").collect()))
    assert left == [(1, [0, 5, 6], [0, 1, 1], [-100, -100, 6]), (1, [5, 6, 7], [1, 1, 1], [-100, 6, 7]), (2, [9], [1], [9])]


def test_array_measures(spark):
    assert one(spark, A.supervised(ints(-100, 5, -100, 6))) == 2
    assert one(spark, A.hit_limit(ints(4, 5, 0, 0), 2)) is True and one(spark, A.hit_limit(ints(4, 0), 2)) is False
    assert one(spark, A.completion(ints(1, 2), ints(1, 2, 3))) == [3]
    assert one(spark, A.squeeze(F.array(ints(1, 2)))) == [1, 2]
    assert one(spark, A.same_sizes(ints(1), ints(2))) and not one(spark, A.same_sizes(ints(1), ints()))
    assert one(spark, A.cycled(F.lit(7), F.lit(3))) == 1
    assert one(spark, A.fit_reason(ints(1, 2, 3), ints(-100, 2, 3), 2)) == "sequence_too_long"
    assert one(spark, A.fit_reason(ints(1), ints(-100), 2)) == "no_supervised_tokens"
    assert one(spark, A.fit_reason(ints(1, 2), ints(-100, 2), 2)) is None
    assert evaluate(spark, ["aé\U0001f642"], A.code_points(F.col("x"))) == [[97, 233, 128578]]


def test_product_norm(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(3, 7)), rng.normal(size=(5, 3))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<array<double>>, b array<array<double>>")
    assert df.select(A.product_norm(F.col("a"), F.col("b"), F.lit(2.0))).first()[0] == pytest.approx(2 * np.linalg.norm(b @ a))


def test_dense_numbers(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    assert sorted((r.k, r.position) for r in A.numbered(df, "k").collect()) == [(i, i + 1) for i in range(1000)]
    assert A.batches(df, 300, "k").groupBy("batch").count().orderBy("batch").collect()[-1]["count"] == 100


# Metrics


def test_chrf_by_hand():
    # "ab" and "ac": one of two characters, none of one pair; the words differ.
    assert M.chrf_counts("ab", "ac")[:6] == [2, 2, 1, 1, 1, 0]
    assert M.chrf_words("don't (stop) now.") == ["don't", "(stop", ")", "now", "."]
    assert float(M.numeric_chrf(M.chrf_counts("same text here", "same text here"))) == pytest.approx(100)
    assert float(M.numeric_chrf(M.chrf_counts("abc", "xyz"))) == 0
    assert float(M.numeric_chrf(M.chrf_counts("", ""))) == 0
    # Effective orders of "ab" and "ac": characters 1 and 2, words 1; precision and recall are each (1/2 + 0 + 0) / 3.
    assert float(M.numeric_chrf(M.chrf_counts("ab", "ac"))) == pytest.approx(100 / 6)


def test_scores_agree_with_numpy(spark):
    pairs = [("the cat sat", "the cat sat on it"), ("", "x"), ("x", ""), ("a b c d e", "a b c d e"), ("köln!", "Köln")]
    df = spark.createDataFrame(pairs, "h string, r string").select(M.chrf_stats("h", "r").alias("s"))
    found = df.select("s", M.chrf_score(F.col("s")).alias("y")).collect()
    assert [r.y for r in found] == pytest.approx([float(M.numeric_chrf(r.s)) for r in found])
    total = df.agg(M.summed(F.col("s"), M.CHRF_COUNT).alias("s")).select(M.chrf_score(F.col("s"))).first()[0]
    assert total == pytest.approx(float(M.numeric_chrf(np.sum([r.s for r in found], axis=0))))


def test_bleu(spark):
    def score(h, r):
        df = spark.createDataFrame([(h, r)], "h string, r string").select(M.bleu_stats("h", "r").alias("s"))
        return df.select(M.bleu_score(F.col("s"))).first()[0]

    assert score("a b c d e", "a b c d e") == pytest.approx(100)
    assert score("a b c", "x y z") == 0 and score("", "x") == 0
    # 4 of 5 words, 2 of 4 pairs, 0 of 3 and of 2: smoothed to 1/2 and 1/4 of their numbers.
    expected = 100 * (4 / 5 * 2 / 4 * (1 / (2 * 3)) * (1 / (4 * 2))) ** 0.25
    assert score("a b x d e", "a b c d e") == pytest.approx(expected)
    brief = 100 * np.exp(1 - 6 / 4)
    assert score("a b c d", "a b c d e f") == pytest.approx(brief)
    assert M.bleu_tokens("It's 3.5, \"so\" (yes) 10-15 a&amp;b.") == ["It's", "3.5", ",", '"', "so", '"', "(", "yes", ")", "10", "-", "15", "a", "&", "b", "."]
