"""Command line, pages, digests, progress, checks of arrays, browsing and the choice of bootstrap."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiteloom.__main__ import main, named
from kiteloom.control import checkpoints
from kiteloom.functions import arrays as A
from kiteloom.functions.metrics import BLEU_SIGNATURE, CHRF_SIGNATURE
from kiteloom.operators import evaluate, summary
from kiteloom.sources import readers, sinks

from .test_plans import corpus


def echo(most):
    """A translator that gives its texts back, cut to so many words."""
    return lambda texts: [(" ".join(t.split()[:most]), len(t.split()) > most) for t in texts]


def test_generate_and_report_commands(tmp_path, spark):
    path = tmp_path / "s.json"
    sections = "project paths dataset model quantization lora training evaluation preflight".split()
    raw = {s: {} for s in sections} | {"run": {"run_id": "cli"}, "paths": {"artifact_root": str(tmp_path / "a")}, "evaluation": {"test_generation_samples": 6, "bootstrap_samples": 20}}
    path.write_text(json.dumps(raw))
    config = ["--config", str(path)]
    assert main(["prepare", *config, "--data", str(corpus(tmp_path / "raw.tsv", 60))]) == 0
    one = ["generate", *config, "--translator", "tests.test_surface:echo", "--max-new-tokens", "1"]
    assert main([*one, "--system", "base", "--limit", "2", "--batch-size", "1"]) == 0
    store = tmp_path / "a" / "parallel-corpus" / "cli" / "evaluation" / "predictions_base.jsonl"
    assert len(store.read_text("utf-8").splitlines()) == 2
    assert main([*one, "--system", "base"]) == main([*one, "--system", "tuned"]) == 0
    rows = [json.loads(line) for line in store.read_text("utf-8").splitlines()]
    assert len(rows) == 6 and all(r["hit_token_limit"] and " " not in r["prediction"] for r in rows)
    assert main(["generate", *config, "--system", "base", "--translator", "tests.test_surface:nothing"]) == 1
    assert main(["report", *config]) == 0
    found = readers.read_json(store.parent.parent / "reports" / "evaluation_report.json")
    assert found["systems"]["tuned"]["chrf_signature"] == CHRF_SIGNATURE and found["systems"]["copy_source"]["bleu_signature"] == BLEU_SIGNATURE
    assert found["significance"]["tuned"]["draws"] == "numpy" and found["significance"]["tuned"]["observed_delta"] == 0
    with pytest.raises(ValueError):
        named("tests.test_surface")


def test_bootstrap_by_number_of_records(spark):
    rows = [(f"r{i}", s, f"w{i} x{i} y", f"w{i} x{i} " + ("y" if s == "b" else "z"), "q") for i in range(8) for s in "ab"]
    stats = evaluate.scored(spark.createDataFrame(rows, "record_id string, system string, target string, prediction string, source string")).cache()
    few, many = (evaluate.paired_bootstrap(stats, "a", "b", 30, 1, most=m) for m in (8, 7))
    assert (few["draws"], many["draws"]) == ("numpy", "hash") and few["observed_delta"] == many["observed_delta"] > 0
    assert few.keys() == many.keys() and few["p_value"] == many["p_value"] == round(1 / 31, 4)
    assert evaluate.paired_bootstrap(stats, "a", "none", 30, 1) is None is evaluate.paired_bootstrap(stats, "a", "b", 0, 1)
    stats.unpersist()


def test_array_checks(spark):
    rows = [(0, [1.0, -2.0]), (1, [0.0, -0.0]), (2, [float("nan")]), (3, [0.0, float("-inf")]), (4, []), (5, None), (6, [None, 1.0]), (7, [None])]
    x = F.col("x")
    got = spark.createDataFrame(rows, "i int, x array<double>").select("i", A.all_finite(x).alias("f"), A.any_nonzero(x).alias("n")).orderBy("i").collect()
    assert [r.f for r in got] == [True, True, False, False, True, None, False, False]
    assert [r.n for r in got] == [True, False, True, True, False, None, True, False]


def test_browsing(spark):
    rows = [("a", 10.0, 20.0, "Red"), ("b", 30.0, 35.0, "red hat"), ("c", 5.0, 5.0, None), ("d", 1.0, 11.0, "blue"), ("e", None, None, "red")]
    df = spark.createDataFrame(rows, "k string, x double, y double, t string")
    keys = lambda *a, **b: [r.k for r in summary.browsed(df, "x", "y", "k", *a, **b).collect()]
    assert keys() == list("adbce") and keys("high") == list("badce") and keys("low") == list("cdabe")
    assert keys("high", search="RED", within=["t"]) == list("bae") and keys(count=1) == ["a"] and keys(search="x") == []
    with pytest.raises(ValueError):
        summary.browsed(df, "x", "y", "k", "random")


def test_trial_predictions(spark, tmp_path):
    row = {c: c for c in sinks.TRIAL} | {"more": "no"}
    digest = sinks.write_trial(spark.createDataFrame([row, row | {"record_id": "a"}]), tmp_path / "t.csv")
    lines = (tmp_path / "t.csv").read_text().splitlines()
    assert lines[0] == "record_id,group_id,source,target,base_prediction,tuned_prediction" and lines[1].startswith("a,") and len(lines) == 3
    assert digest == hashlib.sha256((tmp_path / "t.csv").read_bytes()).hexdigest()


def tensors(path, values):
    """A tensor file: length of the header, header, then all values."""
    header, body = {}, b""
    for name, value in values.items():
        data = value.tobytes()
        header[name] = {"dtype": "F32", "shape": list(value.shape), "data_offsets": [len(body), len(body) + len(data)]}
        body += data
    head = json.dumps(header).encode()
    path.write_bytes(len(head).to_bytes(8, "little") + head + body)
    return path


def test_weights_digest(tmp_path):
    a, b = np.arange(6, dtype="<f4").reshape(2, 3), np.ones(2, "<f4")
    want = hashlib.sha256(b"a" + a.tobytes() + b"b" + b.tobytes()).hexdigest()
    assert readers.weights_digest(tensors(tmp_path / "x", {"b": b, "a": a})) == readers.weights_digest(tensors(tmp_path / "y", {"a": a, "b": b})) == want
    assert readers.weights_digest(tensors(tmp_path / "z", {"a": a, "b": b * 2})) != want
    with pytest.raises(ValueError, match="no tensors"):
        readers.weights_digest(tensors(tmp_path / "none", {}))


def test_progress(tmp_path):
    state = {"global_step": 50, "max_steps": 100, "log_history": [{"loss": 2.0}, {"loss": 1.5}, {"eval_loss": 9.0}]}
    found = checkpoints.record_progress(tmp_path / "p.json", state, clock=lambda: "now")
    assert found == readers.read_json(tmp_path / "p.json") == {"global_step": 50, "max_steps": 100, "checkpoint": "checkpoint-50", "latest_train_loss": 1.5, "saved_at_utc": "now"}
    assert checkpoints.record_progress(tmp_path / "p.json", {"global_step": 0, "max_steps": 1})["latest_train_loss"] is None


def test_page_and_card():
    page = sinks.html_page({"explorer": [{"source": "</script><b>$title"}], "explorer_total": 1}, "a <b> $x")
    assert page.count("</script>") == 2 and "<h1>a &lt;b&gt; $x</h1>" in page and '"<\\/script><b>$title"' in page
    scores = {"base": {"chrfpp": 1.0, "bleu": 2.0, "exact_copy_rate": 0.5}}
    report = {"systems": scores, "sentences": 7, "max_new_tokens": 64, "test_sha256": "abc", "training": {"global_step": 9, "best_dev_loss": 0.25}}
    card = sinks.model_card(report, "T", "s", "t", {"sample seed": 3})
    for part in ("# T", "1.00", "sample seed: 3", "optimizer steps: 9", "best dev loss: 0.25", "at most 64", "abc", "## Use", "## Limits", "sample of 7"):
        assert part in card
