import json
import random

import duckdb
import pytest

import __spark_entry__
from kiteloom.__main__ import main
from kiteloom.control import checkpoints, config
from kiteloom.control.run import STAGES, Layout, RunState, logger, manifest, preflight, write_manifest
from kiteloom.plans import catalog, prepare, report
from kiteloom.sources import readers, sinks


def settings(tmp_path, **changes):
    raw = {s: {} for s in config.Experiment.__dataclass_fields__}
    raw["run"] = {"run_id": "r1"}
    raw["paths"] = {"artifact_root": str(tmp_path / "artifacts")}
    for name, value in changes.items():
        section, key = name.split("__")
        raw[section][key] = value
    return config.build(raw)


def corpus(path, groups=30, each=1):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("कखगघचछजझटठडढतथदधनपफबभमयरल") for _ in range(5))
    lines = ["record_id\tgroup_id\tsource\ttarget\textra"]
    for g in range(groups):
        for k in range(each):
            lines.append(f"r{g}-{k}\tg{g}\t{word()} {word()}\t{word()} {word()}\tx")
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return path


# Settings and control


def test_settings_are_strict(tmp_path):
    s = settings(tmp_path)
    assert config.as_dict(s)["dataset"]["train_ratio"] == 0.8
    for bad in ({"dataset__train_ratio": 0.7}, {"dataset__min_length_ratio": 2.0}, {"lora__rank": 0}, {"lora__dropout": 1.0}, {"run__run_id": "a b"}, {"quantization__load_in_4bit": False}, {"dataset__encoding": "latin-1"}, {"project__seed": "x"}, {"lora__unknown": 1}):
        with pytest.raises(ValueError):
            settings(tmp_path, **bad)
    with pytest.raises(ValueError):
        s.lora.rank = 1000
    with pytest.raises(ValueError):
        s.dataset.dev_ratio = 0.3
    assert s.dataset.dev_ratio == 0.1
    with pytest.raises(ValueError, match="missing sections"):
        config.build({"run": {"run_id": "a"}})


def test_overrides(tmp_path, monkeypatch):
    raw = {s: {} for s in config.Experiment.__dataclass_fields__} | {"run": {"run_id": "r1"}, "project": {"name": "$NAME-${NAME}"}}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(raw))
    monkeypatch.setenv("NAME", "x")
    monkeypatch.setenv("KITELOOM_RUN_ID", "other")
    monkeypatch.setenv("KITELOOM_DATA_FILE", "/data.tsv")
    s = config.load(path)
    assert (s.project.name, s.run.run_id, str(s.paths.raw_data_file)) == ("x-x", "other", "/data.tsv")
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.yaml")


def test_run_state(tmp_path):
    ticks = iter(range(100))
    state = RunState(tmp_path / "state.json", "r1", clock=lambda: str(next(ticks)))
    at = lambda: state.read()["stages"]["training"]
    assert set(state.read()["stages"]) == set(STAGES) and at()["status"] == "pending"
    state.started("training", "go")
    assert at()["status"] == "running" and at()["completed_at_utc"] is None
    state.completed("training")
    assert at()["status"] == "completed" and at()["completed_at_utc"]
    state.started("training")
    assert at()["completed_at_utc"] is None
    state.failed("training", "why")
    assert RunState(tmp_path / "state.json", "r1").read()["stages"]["training"]["message"] == "why"
    with pytest.raises(ValueError):
        state.started("lunch")


def test_layout_manifest_and_preflight(tmp_path):
    s = settings(tmp_path)
    layout = Layout(s)
    layout.create()
    assert layout.run == tmp_path / "artifacts" / "parallel-corpus" / "r1" and layout.data.is_dir()
    with pytest.raises(RuntimeError, match="mounted"):
        Layout(s, needs_mount=str(tmp_path)).create()
    write_manifest(manifest(s), layout)
    assert readers.read_json(layout.report("experiment_manifest.json"))["status"] == "initialized"

    def broken():
        raise OSError("no")

    found = preflight(s, layout, more=[("broken", broken)])
    by_name = {c["name"]: c["status"] for c in found["checks"]}
    assert by_name["broken"] == "FAIL" and not found["ready"] and by_name["metric"] == by_name["python"] == "PASS"
    assert preflight(s, layout)["ready"] and not preflight(s, layout, require_data=True)["ready"]
    log = logger(tmp_path / "x.log")
    assert logger(tmp_path / "x.log") is log and sum(getattr(h, "baseFilename", "") == str(tmp_path / "x.log") for h in log.handlers) == 1


def checkpoint(folder, step, skip=None, state=None):
    path = folder / f"checkpoint-{step}"
    path.mkdir(parents=True)
    for name in checkpoints.REQUIRED:
        if name != skip:
            (path / name).write_text("x")
    if skip != "trainer_state.json":
        (path / "trainer_state.json").write_text(state or json.dumps({"global_step": step, "max_steps": 200}))
    return path


def test_checkpoints(tmp_path):
    assert checkpoints.newest(tmp_path) == (None, [])
    for i, name in enumerate(checkpoints.REQUIRED):
        assert not checkpoints.is_complete(checkpoint(tmp_path / "each", i, skip=name))
    good = checkpoint(tmp_path / "t", 25)
    better = checkpoint(tmp_path / "t", 100)
    broken = [checkpoint(tmp_path / "t", 150, state="{"), checkpoint(tmp_path / "t", 125, state='{"global_step": 1}')]
    (checkpoint(tmp_path / "t", 160) / "optimizer.pt").write_text("")
    assert checkpoints.newest(tmp_path / "t") == (better, [tmp_path / "t" / "checkpoint-160", *broken])
    moved = checkpoints.quarantine(broken, tmp_path / "q")
    assert all(m.is_dir() for m in moved) and not broken[0].exists() and good.exists()
    assert checkpoints.snapshot(good, tmp_path / "s") and not checkpoints.snapshot(better, tmp_path / "s")
    for value in (0.9, 0.8):
        checkpoints.swap_best(better, tmp_path / "best", {"eval_loss": value})
        assert checkpoints.best_value(tmp_path / "best") == value
    assert checkpoints.best_value(tmp_path / "none") is None and checkpoints.describe(better)["global_step"] == 100


def test_resume_guard(tmp_path):
    base = config.as_dict(settings(tmp_path))
    own = lambda **t: checkpoints.fingerprint({**base, "training": base["training"] | t}, {"train": "abc"})
    path = tmp_path / "f.json"
    with pytest.raises(ValueError, match="no fingerprint"):
        checkpoints.verify_resume(path, own())
    checkpoints.store_fingerprint(path, own())
    with pytest.raises(FileExistsError):
        checkpoints.store_fingerprint(path, own(learning_rate=1.0))
    assert checkpoints.verify_resume(path, own()) is None and checkpoints.verify_resume(path, own(save_steps=99)) is None
    with pytest.raises(ValueError, match="learning_rate"):
        checkpoints.verify_resume(path, own(learning_rate=1.0))
    with pytest.raises(ValueError, match="max_steps"):
        checkpoints.verify_resume(path, own(max_steps=20))
    assert checkpoints.verify_resume(path, own(max_steps=20), allow_extension=True) == 10
    with pytest.raises(ValueError):
        checkpoints.verify_resume(path, own(max_steps=5), allow_extension=True)
    with pytest.raises(ValueError, match="data.train"):
        checkpoints.verify_resume(path, checkpoints.fingerprint(base | {"training": base["training"] | {"max_steps": 20}}, {"train": "other"}))
    assert checkpoints.differences({"a": None}, {}) == ["a"]


# Plans


def test_preparation(spark, tmp_path):
    s = settings(tmp_path)
    raw = corpus(tmp_path / "raw.tsv")
    found = prepare.prepare(spark, s, raw)
    layout = Layout(s)
    assert found["cleaning_result"]["rows_kept"] == 30 and not any(found["leakage_checks"].values())
    assert sum(x["rows"] for x in found["splits"].values()) == 30 and found["splits"]["train"]["rows"] == 24
    assert found["splits"]["test"]["sha256"] in layout.report("test_set.sha256").read_text()
    audit = readers.read_delimited(spark, layout.report("data_cleaning_report.csv"), sep=",")
    assert audit.count() == 30 and {"status", "reason", "split"} <= set(audit.columns)
    assert readers.read_prepared(spark, layout.split("train")).count() == 24
    before = layout.split("test").read_bytes()
    prepare.prepare(spark, s, raw)
    assert layout.split("test").read_bytes() == before
    state = readers.read_json(layout.report("run_state.json"))["stages"]["data_preparation"]
    assert state["status"] == "completed"
    with pytest.raises(FileNotFoundError):
        prepare.prepare(spark, s, tmp_path / "none.tsv")
    assert readers.read_json(layout.report("run_state.json"))["stages"]["data_preparation"]["status"] == "failed"


def test_generation_and_report(spark, tmp_path):
    s = settings(tmp_path, evaluation__test_generation_samples=10, evaluation__bootstrap_samples=50)
    prepare.prepare(spark, s, corpus(tmp_path / "raw.tsv", 100))
    layout = Layout(s)
    adapter = tmp_path / "adapter"
    adapter.mkdir()
    (adapter / "adapter_model.safetensors").write_text("x")
    rows, _ = report.test_sample(spark, s, layout)
    answers = {r.source: r.target for r in rows.collect()}
    assert len(answers) == 10
    copy = lambda: lambda texts: [(t, False) for t in texts]
    assert report.generate(spark, s, "base", copy, limit=4) == 6
    tuned = lambda: lambda texts: [(answers[t], True) for t in texts]
    assert report.generate(spark, s, "tuned", tuned, adapter=str(adapter)) == 0
    with pytest.raises(ValueError, match="incomplete"):
        report.report(spark, s)
    partial = report.report(spark, s, allow_partial=True)
    assert partial["partial"] and partial["sentences"] == 4 and not (layout.run / "package").exists()
    assert report.generate(spark, s, "base", copy) == 0
    with pytest.raises(ValueError, match="max_new_tokens"):
        report.generate(spark, s, "base", copy, max_new_tokens=99)
    done = report.report(spark, s)
    assert done["systems"]["tuned"]["chrfpp"] == 100 and done["systems"]["tuned"]["hit_token_limit_rate"] == 1
    assert done["systems"]["base"]["chrfpp"] == done["systems"]["copy_source"]["chrfpp"]
    assert done["significance"]["tuned"]["ci95_low"] > 0 and done["max_new_tokens"] == 256
    assert (layout.evaluation / "most_improved.csv").exists() and (layout.run / "package" / "README.md").exists()
    assert readers.read_json(layout.report("experiment_manifest.json"))["status"] == "evaluated_and_packaged"
    sinks.write_json({"log_history": [{"step": 1, "loss": 2.0}, {"step": 5, "eval_loss": 1.0}]}, layout.report("training_report.json"))
    data = report.dashboard(spark, layout.run, tmp_path / "page.html", most=5)
    assert data["train_loss"] == [[1, 2.0]] and data["dev_loss"] == [[5, 1.0]] and len(data["explorer"]) == 5 and data["explorer_total"] == 10
    assert (tmp_path / "page.html").read_text("utf-8").startswith("<!doctype html>")


def test_command_line(tmp_path, spark):
    path = tmp_path / "s.json"
    raw = {s: {} for s in config.Experiment.__dataclass_fields__} | {"run": {"run_id": "cli"}, "paths": {"artifact_root": str(tmp_path / "a")}}
    path.write_text(json.dumps(raw))
    assert main(["preflight", "--config", str(path)]) == 0
    assert main(["prepare", "--config", str(path), "--data", str(corpus(tmp_path / "raw.tsv"))]) == 0
    assert main(["prepare", "--config", str(path), "--data", str(tmp_path / "none")]) == 1
    assert main(["report", "--config", str(path)]) == 1


# Queries


def plain(value):
    return None if value is None or value != value else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations", "pages", "embeddings", "events", "part", "lineitem"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    own = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(own.columns)
    found = sorted(repr([plain(r[c]) for c in columns]) for r in own.collect())
    sql = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert found == sorted(repr([plain(v) for v in r]) for r in con.sql(f"SELECT {quoted} FROM ({catalog.ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_scans_read_only_the_columns_they_need(spark, sf_dir):
    plan = catalog.QUERIES["norms_by_label"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<embedding:array<float>,label:int>" in plan and "vec_id" not in plan
    plan = catalog.QUERIES["latest_loss"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "props" not in plan
