"""Where a training run goes on, from the command line and by itself."""

import json

import pytest

from kiteloom.__main__ import main
from kiteloom.control import config
from kiteloom.control.run import Layout
from kiteloom.plans.resume import resume
from kiteloom.sources.readers import read_json

from .test_plans import checkpoint


@pytest.fixture
def run(tmp_path):
    sections = "project paths dataset model quantization lora evaluation preflight".split()

    def at(steps, **training):
        raw = {s: {} for s in sections} | {"run": {"run_id": "r"}, "paths": {"artifact_root": str(tmp_path / "a")}, "training": {"max_steps": steps} | training}
        (tmp_path / "s.json").write_text(json.dumps(raw))
        settings = config.load(tmp_path / "s.json")
        Layout(settings).create()
        for split in ("train", "dev"):
            Layout(settings).split(split).write_text(split)
        return settings

    return at


def test_begin_resume_and_extend(run, tmp_path):
    layout = Layout(run(100))
    assert resume(run(100)) == {"action": "begin", "checkpoint": None, "global_step": 0, "max_steps": 100, "extended_from": None}
    assert resume(run(100))["action"] == "begin"  # nothing saved yet, the same settings
    with pytest.raises(ValueError, match="learning_rate"):
        resume(run(100, learning_rate=0.5))
    half = checkpoint(layout.trainer, 50)
    checkpoint(layout.trainer, 75, state="{")
    found = resume(run(100))
    assert (found["action"], found["checkpoint"], found["global_step"]) == ("resume", str(half), 50)
    assert len(list(layout.incomplete.iterdir())) == 1
    full = checkpoint(layout.trainer, 100)
    assert resume(run(100))["action"] == "nothing"
    with pytest.raises(ValueError, match="max_steps"):
        resume(run(150))
    found = resume(run(150), extend=True)
    assert (found["action"], found["checkpoint"], found["extended_from"]) == ("resume", str(full), 100)
    assert (layout.checkpoints / "adapter_step_100" / "adapter_model.safetensors").exists()
    assert [e["to_max_steps"] for e in read_json(layout.report("experiment_manifest.json"))["training_extensions"]] == [150]
    assert resume(run(150))["extended_from"] is None
    layout.split("train").write_text("other")
    with pytest.raises(FileNotFoundError):
        layout.split("dev").unlink()
        resume(config.load(tmp_path / "s.json"))


def test_command(run, tmp_path):
    layout = Layout(run(10))
    arguments = ["resume", "--config", str(tmp_path / "s.json")]
    assert main(arguments) == 0 and read_json(layout.report("resume.json"))["action"] == "begin"
    checkpoint(layout.trainer, 10)
    run(20)
    assert main(arguments) == 1 and main([*arguments, "--extend"]) == 0
    assert read_json(layout.report("resume.json"))["extended_from"] == 10
