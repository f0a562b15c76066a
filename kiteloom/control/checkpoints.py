"""Checkpoint folders, training fingerprints and guards against mixing runs."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path
from typing import Any

from kiteloom.sources.readers import checkpoint_step, read_json, scan_checkpoints
from kiteloom.sources.sinks import write_json

from .run import now, stamp

# The files of a whole checkpoint, settings that a resumed run may change, and settings of a generation.
REQUIRED = ("trainer_state.json", "optimizer.pt", "scheduler.pt", "adapter_config.json", "adapter_model.safetensors")
RESUME_SAFE = frozenset({"logging_steps", "evaluation_steps", "eval_examples", "eval_batch_size", "save_steps", "save_total_limit"})
GENERATION = ("model_repo_id", "adapter_path", "adapter_sha256", "max_new_tokens", "test_sha256")


def is_complete(folder: str | Path) -> bool:
    """Whether all required files are there, none is empty, and the state's step is the folder's."""
    folder = Path(folder)
    if any(not (folder / name).is_file() or not (folder / name).stat().st_size for name in REQUIRED):
        return False
    try:
        return read_json(folder / "trainer_state.json").get("global_step") == checkpoint_step(folder.name)
    except (ValueError, OSError):
        return False


def newest(folder: str | Path) -> tuple[Path | None, list[Path]]:
    """The newest complete checkpoint, and the newer ones that aren't."""
    broken: list[Path] = []
    for _, path in scan_checkpoints(folder):
        if is_complete(path):
            return path, broken
        broken.append(path)
    return None, broken


def quarantine(folders: Iterable[Path], to: str | Path) -> list[Path]:
    """Moves folders aside under a time stamp; nothing is deleted."""
    moved = []
    for folder in folders:
        goal = Path(to) / f"{folder.name}-{stamp()}"
        n = 1
        while goal.exists():
            goal, n = goal.with_name(f"{goal.name}.{n}"), n + 1
        goal.parent.mkdir(parents=True, exist_ok=True)
        shutil.move(folder, goal)
        moved.append(goal)
    return moved


def snapshot(source: str | Path, goal: str | Path) -> bool:
    """Copies a folder once, by a staging folder; False if the goal is there already."""
    goal = Path(goal)
    if goal.exists():
        return False
    staging = goal.with_name(goal.name + ".tmp")
    shutil.rmtree(staging, ignore_errors=True)
    shutil.copytree(source, staging)
    os.replace(staging, goal)
    return True


def swap_best(source: str | Path, goal: str | Path, value: Mapping[str, Any]) -> None:
    """Puts a new best adapter, with its value, in the place of the old one; a whole one is there at any time but between two renames."""
    goal = Path(goal)
    fresh, old = goal.with_name(goal.name + ".tmp"), goal.with_name(goal.name + ".old")
    for path in (fresh, old):
        shutil.rmtree(path, ignore_errors=True)
    shutil.copytree(source, fresh)
    write_json(value, fresh / "best_metric.json")
    if goal.exists():
        os.replace(goal, old)
    os.replace(fresh, goal)
    shutil.rmtree(old, ignore_errors=True)


def best_value(folder: str | Path) -> float | None:
    found = read_json(Path(folder) / "best_metric.json", lenient=True).get("eval_loss")
    return None if found is None else float(found)


def describe(folder: str | Path) -> dict[str, Any]:
    state = read_json(Path(folder) / "trainer_state.json")
    return {"path": str(folder), "global_step": state.get("global_step"), "max_steps": state.get("max_steps")}


def fingerprint(settings: Mapping[str, Any], data: Mapping[str, str]) -> dict[str, Any]:
    """What decides a training: settings of model, adapter and training but those a resume may change, and data digests."""
    out: dict[str, Any] = {f"data.{k}": v for k, v in data.items()}
    for section in ("model", "quantization", "lora", "training"):
        out |= {f"{section}.{k}": v for k, v in settings[section].items() if not (section == "training" and k in RESUME_SAFE)}
    out["project.seed"] = settings["project"]["seed"]
    return out


def differences(a: Mapping[str, Any], b: Mapping[str, Any]) -> list[str]:
    """Sorted names whose values differ, or that only one side has."""
    gone = object()
    return sorted(k for k in {*a, *b} if a.get(k, gone) != b.get(k, gone))


def store_fingerprint(stored: str | Path, own: Mapping[str, Any]) -> None:
    """Keeps the fingerprint of a run that begins; one that is there already raises ``FileExistsError``."""
    if Path(stored).exists():
        raise FileExistsError(f"a run has begun here: {stored}")
    write_json(own, stored)


def verify_resume(stored: str | Path, own: Mapping[str, Any], allow_extension: bool = False) -> int | None:
    """Compares the settings of a run that goes on with the fingerprint stored when it began.

    Differences raise ``ValueError``, and so does a missing fingerprint: such a
    run is of unknown origin. ``allow_extension`` permits a larger number of steps
    and nothing else; the old number is then returned and the new fingerprint stored.
    """
    stored = Path(stored)
    if not stored.exists():
        raise ValueError(f"no fingerprint of the run to resume: {stored}")
    before = read_json(stored)
    changed = differences(before, json.loads(json.dumps(own, default=str)))
    if not changed:
        return None
    steps = "training.max_steps"
    if changed == [steps] and allow_extension and own[steps] > before[steps]:
        write_json(own, stored)
        return int(before[steps])
    raise ValueError(f"the run was begun with other settings: {changed}")


def record_progress(path: str | Path, state: Mapping[str, Any], clock: Callable[[], str] = now) -> dict[str, Any]:
    """How far a training run is, written at each saved checkpoint from its trainer state; the loss is the latest one logged, or null."""
    losses = [entry["loss"] for entry in state.get("log_history", []) if "loss" in entry]
    progress = {
        "global_step": state["global_step"],
        "max_steps": state["max_steps"],
        "checkpoint": f"checkpoint-{state['global_step']}",
        "latest_train_loss": losses[-1] if losses else None,
        "saved_at_utc": clock(),
    }
    write_json(progress, path)
    return progress


def check_generation(path: str | Path, own: Mapping[str, Any]) -> None:
    """Compares the settings of a generation with the stored ones, or stores them; a mismatch raises ``ValueError`` with its names."""
    path = Path(path)
    if not path.exists():
        write_json(own, path)
        return
    before = read_json(path)
    changed = [k for k in GENERATION if before.get(k) != own.get(k)]
    if changed:
        raise ValueError(f"predictions were made with other settings: {changed}")
