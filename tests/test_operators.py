import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kiteloom.functions import text as X
from kiteloom.operators import clean, evaluate, history, split, summary, translate

PAIRS = "raw_row_number int, record_id string, group_id string, source string, target string"
GOOD = "भाषा शब्द है"


def pairs(spark, rows):
    return spark.createDataFrame([(i + 2, str(i), f"g{i}", s, t) for i, (s, t) in enumerate(rows)], PAIRS)


def reasons(df, rules=clean.Rules()):
    return [r.reason for r in clean.cascade(df, rules).orderBy("raw_row_number").collect()]


def test_reasons_and_lossless_audit(spark):
    df = pairs(spark, [(GOOD, "हिंदी शब्द"), (GOOD, "हिंदी  शब्द"), (".", "हिंदी"), ("latin only", "हिंदी शब्द"), ("दुसरा शब्द", "एक गोष्ट"), ("दुसरा शब्द", "दोन गोष्टी")])
    assert reasons(df) == ["", "exact_duplicate_pair", "source_too_short", "low_source_script_ratio"] + ["conflicting_source_translation"] * 2
    rows = clean.cascade(df)
    audited = clean.audit(rows).collect()
    assert len(audited) == 6 and sum(r.status == "kept" for r in audited) == 1
    assert {r.reason: r.rows for r in clean.drop_counts(rows).collect()}["conflicting_source_translation"] == 2
    assert clean.kept(rows, "a", "b", "c").columns[1:] == list(clean.CANONICAL)


def test_first_rule_wins_and_bounds_are_kept(spark):
    rows = [("", ""), (GOOD, ""), ("क", "x"), (GOOD, "x"), ("abc", "हिंदी"), ("क" * 5, "म" * 20), ("क" * 40, "म" * 20), ("क" * 4, "म" * 20), ("क" * 41, "म" * 20), (None, None)]
    assert reasons(pairs(spark, rows)) == ["empty_source", "empty_target", "source_too_short", "target_too_short", "low_source_script_ratio", "", "", "extreme_length_ratio", "extreme_length_ratio", "empty_source"]


def test_dropped_rows_make_neither_conflicts_nor_first_copies(spark):
    long = "म" * 60
    assert reasons(pairs(spark, [(GOOD, long), (GOOD, "हिंदी शब्द"), (GOOD, "हिंदी शब्द")])) == ["extreme_length_ratio", "", "exact_duplicate_pair"]
    keep = clean.Rules(drop_duplicates=False)
    assert reasons(pairs(spark, [(GOOD, "हिंदी शब्द")] * 2), keep) == ["", ""]


def test_normalized_before_compared(spark):
    assert reasons(pairs(spark, [("क़ शब्द", "हिंदी शब्द"), ("क़​ शब्द", " हिंदी शब्द ")])) == ["", "exact_duplicate_pair"]


def test_invariants(spark):
    clean.require_clean(clean.kept(clean.cascade(pairs(spark, [(GOOD, "हिंदी शब्द")])), "a", "b", "c"))
    with pytest.raises(ValueError, match="no pair"):
        clean.require_clean(pairs(spark, []))
    with pytest.raises(ValueError, match="conflicting source"):
        clean.require_clean(pairs(spark, [("a", "b"), ("a", "c")]))
    twice = pairs(spark, [("a", "b")] * 2)
    with pytest.raises(ValueError, match="repeated pair"):
        clean.require_clean(twice)
    clean.require_clean(twice, clean.Rules(drop_duplicates=False))


def test_a_hot_pair(spark):
    rows = [(GOOD, "हिंदी शब्द")] * 400 + [("", "x")] * 300 + [(f"शब्द {i} कक", "हिंदी शब्द") for i in range(50)]
    found = reasons(pairs(spark, rows))
    assert found.count("") == 51 and found.count("exact_duplicate_pair") == 399 and found.count("empty_source") == 300


# Splits


def grouped(spark, groups=30, each=2):
    return spark.createDataFrame([(g * each + k, f"r{g}-{k}", f"g{g}", f"s{g}-{k}", f"t{g}") for g in range(groups) for k in range(each)], PAIRS)


@pytest.mark.parametrize("rng", ["reference", "hash", "ranges"])
def test_splits_are_repeatable_and_disjoint(spark, rng):
    df = grouped(spark, 60 if rng == "ranges" else 30)
    a, b = ({r.record_id: r.split for r in split.split_groups(d, rng=rng).collect()} for d in (df, df.repartition(5)))
    assert a == b and len(a) == df.count()
    by_group = {}
    for record, name in a.items():
        assert by_group.setdefault(record.split("-")[0], name) == name
    assert set(a.values()) == {"train", "dev", "test"}
    split.require_no_leakage(split.split_groups(df, rng=rng))


def test_the_fold_fills_the_largest_lack():
    sizes = [(f"g{i}", random.Random(i).randint(1, 9)) for i in range(200)]
    dealt = split.fold(sizes, split.RATIOS, 42)
    total = sum(n for _, n in sizes)
    for name, ratio in split.RATIOS.items():
        assert abs(sum(n for g, n in sizes if dealt[g] == name) - ratio * total) <= 9
    first = sorted(g for g, _ in sizes)
    random.Random(42).shuffle(first)
    assert dealt[first[0]] == "train"
    assert dealt == split.fold(list(reversed(sizes)), split.RATIOS, 42) != split.fold(sizes, split.RATIOS, 43)


def test_split_errors(spark):
    with pytest.raises(ValueError, match="3 groups"):
        split.split_groups(grouped(spark, 2))
    with pytest.raises(ValueError, match="missing"):
        split.split_groups(grouped(spark).drop("target"))
    with pytest.raises(ValueError, match="rng"):
        split.split_groups(grouped(spark), rng="dice")


def test_leakage(spark):
    rows = [("train", "g1", "s1", "t1", "1"), ("dev", "g2", "s2", "t1", "2"), ("test", "g3", "s3", "t3", "3")]
    df = spark.createDataFrame(rows, "split string, group_id string, source string, target string, record_id string")
    with pytest.raises(ValueError, match="target.*dev.*train"):
        split.require_no_leakage(df)
    with pytest.raises(ValueError, match="splits are"):
        split.require_no_leakage(df.where("split <> 'test'"))
    split.require_no_leakage(df.withColumn("target", F.col("source")))


def test_passages(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight y"), (2, "one two three four five six"), (3, None), (4, "ONE two three four five six seven eight")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "one two three four five six seven eight"), (8, "too short"), (7, None)], "item_id long, text string")
    assert [tuple(r) for r in split.contained_passages(docs, items, "doc_id", "text", "item_id", "text").collect()] == [(1, 9)]


# Summaries


def test_numeric_summary(spark):
    values = [1.0, 2.0, 4.0, 8.0, None, 16.5]
    df = spark.createDataFrame([(v, str(v) if v else "x") for v in values], "a double, b string")
    found = {r.column: r for r in summary.numeric_summary(df, "a", "b").collect()}
    s = pd.Series(values).dropna()
    a = found["a"]
    assert (a["count"], a.min, a.p25, a.median, a.p75, a.p95, a.max) == (5, 1.0, s.quantile(0.25), 4.0, s.quantile(0.75), pytest.approx(s.quantile(0.95)), 16.5)
    assert a.mean == pytest.approx(s.mean()) and found["b"]["count"] == 5
    empty = summary.numeric_summary(df.where("false").union(spark.createDataFrame([(None, "x")], df.schema)), "b").first()
    assert empty["count"] == 0 and empty.mean is None


def test_samples(spark):
    df = spark.createDataFrame([(f"r{i:02}", i) for i in range(50)], "record_id string, raw_row_number int")
    for rng in ("hash", "reference"):
        a, b = ([r.record_id for r in summary.sample(d, 10, 42, rng=rng).orderBy("sample_pos").collect()] for d in (df, df.repartition(3)))
        assert a == b and len(a) == 10
        assert summary.sample(df, 500, 42, rng=rng).count() == 50
    drawn = pd.Series([f"r{i:02}" for i in range(50)]).sample(n=10, random_state=42).tolist()
    assert [r.record_id for r in summary.sample(df, 10, 42, rng="reference").orderBy("sample_pos").collect()] == drawn
    assert len({tuple(r.record_id for r in summary.shuffled(df, s).collect()) for s in (1, 2)}) == 2


def test_picks(spark):
    df = spark.createDataFrame([(str(i), float(i), float((i * 7) % 20)) for i in range(20)], "id string, gain double, score double")
    found = {(r["pick"], r["id"]) for r in summary.representative(df, "gain", "score", "id", 5).collect()}
    assert found == {("hardest", "0"), ("typical", next(str(i) for i in range(20) if (i * 7) % 20 == 10)), ("gain", "19"), ("gain", "18"), ("gain", "17")}
    assert summary.representative(df, "gain", "score", "id", 99).count() == 20
    assert [r["id"] for r in summary.extremes(df, "gain", "id", 2).collect()] == ["19", "18"]
    assert sorted(int(r["id"]) for r in summary.every(df.withColumn("k", F.col("id").cast("int")), 7, "k").collect()) == [0, 7, 14]


def test_parameters(spark):
    df = spark.createDataFrame([("model.q.lora_A", 10, True), ("vision.q.lora_A", 5, True), ("model.q", 85, False)], "name string, numel long, trainable boolean")
    r = summary.parameter_census(df, allowed=F.col("name").contains("lora_"), forbidden=["VISION"]).first()
    assert (r.total, r.trainable, r.percentage, r.trainable_tensors, r.violations) == (100, 15, 15.0, 2, ["vision.q.lora_A"])
    modules = spark.createDataFrame([(f"m{i}.q", "Linear") for i in range(8)] * 2 + [("vision.q", "Linear"), ("x", "Norm")], "module string, class string")
    assert summary.target_modules(modules, ["Linear"], ["vision"]) == [f"m{i}.q" for i in range(8)]
    with pytest.raises(ValueError):
        summary.target_modules(modules, ["Norm"], [])
    halves = spark.createDataFrame([("m.q", "A", [[1.0, 2.0]]), ("m.q", "B", [[3.0], [0.0]])], "path string, which string, matrix array<array<double>>")
    assert summary.trained(halves) and not summary.trained(halves.withColumn("matrix", F.expr("transform(matrix, r -> transform(r, x -> 0D))")))
    with pytest.raises(ValueError):
        summary.trained(halves.where("which = 'A'"))
    n = summary.adapter_norms(halves, 1, 2.0).first()
    assert n.norm == pytest.approx(2 * 3 * 5**0.5) and n.weights == 4 and n.module == "q"


def test_map_differences(spark):
    make = lambda d: spark.createDataFrame(list(d.items()), "k string, v string")
    found = {r.k: (r.left, r.right) for r in summary.differences(make({"a": "1", "b": "2", "n": None}), make({"b": "3", "c": "4", "n": None}), "k", "v").collect()}
    assert found == {"a": ("1", None), "b": ("2", "3"), "c": (None, "4")}


# Histories


def test_trailing_mean_against_a_loop(spark):
    rng = random.Random(1)
    train = [(i, rng.random()) for i in range(0, 400, 3)]
    points = [10, 49, 50, 51, 333, 500, 1000]
    found = {r.step: (r.n, r.mean) for r in history.trailing_mean(spark.createDataFrame(train, "step long, value double"), spark.createDataFrame([(p,) for p in points], "step long")).collect()}
    for p in points:
        own = [v for s, v in train if p - 50 < s <= p]
        assert found[p] == (len(own), pytest.approx(sum(own) / len(own)) if own else None)


def test_running_best_and_ends(spark):
    values = [5.0, 4.0, 4.0, 6.0, 3.0, 9.0]
    df = spark.createDataFrame([(i * 700, v, None if i == 5 else v) for i, v in enumerate(values)], "step long, value double, loss double")
    assert [r.improved for r in history.running_best(df.select("step", "value")).orderBy("step").collect()] == [True, True, False, False, True, False]
    assert tuple(history.best(df.select("step", "value")).first()) == (2800, 3.0)
    assert tuple(history.latest(df, "loss").first()) == (2800, 3.0)
    assert history.entries(df, "loss").count() == 5
    b = history.bounds(df.select("step", "value")).first()
    assert (b.x_min, b.x_max, b.y_min, b.y_max, b.first, b.last) == (0, 3500, 3.0, 9.0, 5.0, 9.0)
    assert history.warmup_steps(0.03, 1400) == 42 and history.warmup_steps(0.03, 10) == 1


def test_newest_complete(spark):
    rows = [(f"run/checkpoint-{s}", f, n) for s, files in ((25, "ab"), (100, "ab"), (125, "a"), (150, "ab")) for f, n in ((c, 0 if s == 150 and c == "b" else 5) for c in files)]
    r = history.newest_complete(spark.createDataFrame(rows, "dir string, file string, size long"), ("a", "b")).first()
    assert (r.newest, r.incomplete) == (100, [150, 125])


# Evaluation


def systems(spark, count=30):
    rows = []
    for i in range(count):
        source, target = f"source words number {i} here", f"target phrase {i} with {i % 7} more words"
        for name, p in (("base", source), ("tuned", target), ("tuned_700", target[:-4])):
            rows.append((str(i), name, source, target, p, i % 10 == 0, i + 1))
    return spark.createDataFrame(rows, "record_id string, system string, source string, target string, prediction string, hit_token_limit boolean, sample_pos int")


def test_three_systems(spark):
    rows = evaluate.with_copy_system(systems(spark))
    stats = evaluate.scored(rows.withColumn("source_words", X.word_count(F.col("source"))), ["source_words"])
    found = {r.system: r for r in evaluate.corpus_scores(stats, "system").collect()}
    assert found["tuned"].chrfpp == 100 and found["tuned"].exact_match_rate == 1 and found["base"].exact_copy_rate == 1
    assert found["base"].chrfpp == found["copy_source"].chrfpp < found["tuned_700"].chrfpp < 100
    assert found["base"].chrfpp_vs_source == 100
    drawn = evaluate.significance(stats, "base", "tuned", 200, 42).first()
    exact = evaluate.reference_bootstrap(stats, "base", "tuned", 200, 42)
    assert drawn.observed_delta == pytest.approx(exact["observed_delta"], abs=1e-3) and drawn.ci95_low > 0 and drawn.p_value == exact["p_value"] == round(1 / 201, 4)
    same = evaluate.significance(stats, "tuned", "tuned", 50, 1).first()
    assert (same.observed_delta, same.p_value) == (0, 1) and evaluate.reference_bootstrap(stats, "base", "base", 50, 1)["p_value"] == 1
    none = evaluate.significance(stats, "base", "tuned", 0, 1).first()
    assert none.samples == 0 and none.p_value is None and evaluate.reference_bootstrap(stats, "base", "tuned", 0, 1) is None
    assert {r.length_bucket for r in evaluate.by_length(stats).collect()} == {"1-5"}
    moved = evaluate.deltas(evaluate.sentence_scores(stats), "base", "tuned")
    assert moved.count() == 30 and moved.where("delta <= 0").isEmpty()


def test_alignment(spark):
    rows = systems(spark, 10)
    sample = rows.select("record_id", "source", "target", "sample_pos").distinct()
    part = rows.where("NOT (system = 'base' AND record_id IN ('1', '2'))")
    assert {r.system: r.missing for r in evaluate.missing_predictions(sample, part).collect()} == {"base": 2, "tuned": 0, "tuned_700": 0}
    with pytest.raises(ValueError, match="base"):
        evaluate.require_complete(sample, part)
    assert evaluate.require_complete(sample, part, allow_partial=True) == ["base"]
    kept = evaluate.aligned(sample, part.select("system", "record_id", "prediction"))
    assert sorted({r.record_id for r in kept.collect()}, key=int) == [str(i) for i in range(10) if i not in (1, 2)]
    assert evaluate.remaining(sample, part.where("system = 'base'")).count() == 2
    table = evaluate.wide(rows, evaluate.sentence_scores(evaluate.scored(rows)), ["base", "tuned"])
    assert table.count() == 10 and "hit_token_limit_tuned" in table.columns


def test_comparisons():
    assert evaluate.comparisons(["base", "tuned", "tuned_700"]) == [("base", "tuned"), ("base", "tuned_700"), ("tuned_700", "tuned")]
    assert evaluate.comparisons(["tuned"]) == []


def test_no_sentences_no_scores(spark):
    assert evaluate.corpus_scores(evaluate.scored(systems(spark).where("false")), "system").count() == 0


def test_backoff_keeps_order():
    sizes = []

    def small(texts):
        sizes.append(len(texts))
        if len(texts) > 2:
            raise MemoryError
        return [(t.upper(), False) for t in texts]

    assert [t for t, _ in translate.with_backoff(small, list("abcdefg"))] == list("ABCDEFG")
    assert max(sizes) == 7

    def never(texts):
        raise MemoryError

    with pytest.raises(MemoryError):
        translate.with_backoff(never, ["a", "b"])
    with pytest.raises(ValueError):
        translate.with_backoff(lambda texts: [], ["a"])


def test_translate(spark):
    df = spark.createDataFrame([(str(i), "g", "x" * i, "t") for i in range(20)], "record_id string, group_id string, source string, target string")
    done = translate.translate(df, lambda: lambda texts: [(t + "!", len(t) > 10) for t in texts], batch=3)
    assert {r.record_id: (r.prediction, r.hit_token_limit) for r in done.collect()} == {str(i): ("x" * i + "!", i > 10) for i in range(20)}
