"""A run's folders, state, manifest, environment, log and preflight checks."""

from __future__ import annotations

import importlib.metadata
import logging
import os
import platform
import shutil
import subprocess
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from kiteloom.sources.readers import read_json
from kiteloom.sources.sinks import write_json

from .config import Experiment, as_dict

# The stages of a run, and the packages whose versions are recorded.
STAGES = ("preflight", "data_preparation", "baselines", "training", "adapter_verification", "final_evaluation", "analysis", "packaging")
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def stamp() -> str:
    """A time for file names."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


class Layout:
    """Where a run keeps its files: ``<root>/<project>/<run id>/...``."""

    def __init__(self, settings: Experiment, needs_mount: str | None = None) -> None:
        self.root = Path(settings.paths.artifact_root)
        self.run = self.root / settings.project.name / settings.run.run_id
        self.needs_mount = needs_mount
        self.data, self.reports, self.logs, self.evaluation, self.checkpoints = (self.run / n for n in ("data", "reports", "logs", "evaluation", "checkpoints"))
        self.trainer, self.incomplete, self.best = (self.checkpoints / n for n in ("trainer", "trainer_incomplete", "adapter_best"))

    def split(self, name: str) -> Path:
        return self.data / f"{name}.tsv"

    def report(self, name: str) -> Path:
        return self.reports / name

    def store(self, system: str) -> Path:
        return self.evaluation / f"predictions_{system}.jsonl"

    def create(self) -> None:
        """Makes all folders; refuses to write below a mount point that isn't mounted."""
        if self.needs_mount and Path(self.needs_mount) in [self.root, *self.root.parents] and not os.path.ismount(self.needs_mount):
            raise RuntimeError(f"{self.needs_mount} isn't mounted")
        for folder in (self.data, self.reports, self.logs, self.evaluation, self.trainer, self.best):
            folder.mkdir(parents=True, exist_ok=True)


class RunState:
    """pending, running, completed or failed for each stage, in one document that is replaced as a whole."""

    def __init__(self, path: str | Path, run_id: str, clock: Callable[[], str] = now) -> None:
        self.path, self.clock = Path(path), clock
        if not self.path.exists():
            entry = {"status": "pending", "started_at_utc": None, "completed_at_utc": None, "message": None}
            write_json({"run_id": run_id, "created_at_utc": clock(), "updated_at_utc": clock(), "stages": {s: dict(entry) for s in STAGES}}, self.path)

    def read(self) -> dict[str, Any]:
        return read_json(self.path)

    def _mark(self, stage: str, **changes: Any) -> None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}; stages are {STAGES}")
        state = self.read()
        state["stages"][stage].update(changes)
        write_json(state | {"updated_at_utc": self.clock()}, self.path)

    def started(self, stage: str, message: str | None = None) -> None:
        self._mark(stage, status="running", started_at_utc=self.clock(), completed_at_utc=None, message=message)

    def completed(self, stage: str, message: str | None = None) -> None:
        self._mark(stage, status="completed", completed_at_utc=self.clock(), message=message)

    def failed(self, stage: str, message: str) -> None:
        self._mark(stage, status="failed", completed_at_utc=self.clock(), message=message)


def _git(*args: str) -> str | None:
    try:
        done = subprocess.run(["git", *args], capture_output=True, text=True, timeout=5, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip()


def package_version(name: str) -> str | None:
    try:
        return importlib.metadata.version(name)
    except importlib.metadata.PackageNotFoundError:
        return None


def environment() -> dict[str, Any]:
    changes = _git("status", "--porcelain")
    return {
        "python": platform.python_version(),
        "platform": platform.platform(),
        "packages": {p: package_version(p) for p in PACKAGES},
        "git": {"commit": _git("rev-parse", "HEAD"), "branch": _git("rev-parse", "--abbrev-ref", "HEAD"), "dirty": None if changes is None else bool(changes)},
    }


def manifest(settings: Experiment) -> dict[str, Any]:
    """What a run is, before anything has run."""
    return {
        "schema_version": 1,
        "created_at_utc": now(),
        "updated_at_utc": now(),
        "status": "initialized",
        "settings": as_dict(settings),
        "environment": environment(),
        "dataset": None,
        "trainable_parameters": None,
        "best_checkpoint": None,
        "final_metrics": None,
    }


def write_manifest(value: dict[str, Any], layout: Layout) -> None:
    write_json(value | {"updated_at_utc": now()}, layout.report("experiment_manifest.json"))


def logger(path: str | Path | None = None, name: str = "kiteloom") -> logging.Logger:
    """One shared logger to the console and, appended, to a file; set up once."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    log.propagate = False
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    wanted: list[logging.Handler] = [] if any(type(h) is logging.StreamHandler for h in log.handlers) else [logging.StreamHandler()]
    if path is not None and not any(isinstance(h, logging.FileHandler) and h.baseFilename == os.path.abspath(path) for h in log.handlers):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        wanted.append(logging.FileHandler(path, encoding="utf-8"))
    for handler in wanted:
        handler.setFormatter(form)
        log.addHandler(handler)
    return log


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    message: str


def _versions(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(".")[:3] if x.isdigit())


def preflight(settings: Experiment, layout: Layout, require_data: bool = False, more: Iterable[tuple[str, Callable[[], tuple[str, str]]]] = ()) -> dict[str, Any]:
    """Independent checks, each PASS, WARN or FAIL; one that raises is FAIL. ready: no FAIL."""

    def python() -> tuple[str, str]:
        own = platform.python_version()
        return ("PASS" if _versions(own) >= _versions(settings.preflight.minimum_python) else "FAIL"), own

    def packages() -> tuple[str, str]:
        found = {p: package_version(p) for p in PACKAGES}
        if missing := [p for p, v in found.items() if v is None]:
            return "FAIL", f"missing: {missing}"
        old = _versions(found["pyspark"]) < _versions(settings.preflight.minimum_pyspark)
        return ("FAIL" if old else "PASS"), str(found)

    def disk() -> tuple[str, str]:
        place = layout.root
        while not place.exists():
            place = place.parent
        free = shutil.disk_usage(place).free / 2**30
        return ("PASS" if free >= settings.preflight.minimum_disk_free_gib else "WARN"), f"{free:.1f} GiB free"

    def writable() -> tuple[str, str]:
        layout.create()
        probe = layout.run / ".writable"
        probe.write_text("", encoding="utf-8")
        probe.unlink()
        return "PASS", str(layout.run)

    def metric() -> tuple[str, str]:
        from kiteloom.functions.metrics import chrf_counts, numeric_chrf

        same, other = (float(numeric_chrf(chrf_counts("a small test", t))) for t in ("a small test", "xyz"))
        return ("PASS" if abs(same - 100) < 1e-9 and other == 0 else "FAIL"), f"{same:.2f} and {other:.2f}"

    def data() -> tuple[str, str]:
        path = settings.paths.raw_data_file
        if path is None:
            return ("FAIL" if require_data else "WARN"), "no data file is set"
        if not path.is_file():
            return "FAIL", f"no such file: {path}"
        return "PASS", f"{path}, {path.stat().st_size / 2**20:.1f} MiB"

    results = []
    for name, check in (("python", python), ("packages", packages), ("disk", disk), ("writable", writable), ("metric", metric), ("data", data), *more):
        try:
            results.append(Check(name, *check()))
        except Exception as error:
            results.append(Check(name, "FAIL", f"{type(error).__name__}: {error}"))
    return {"created_at_utc": now(), "python": sys.executable, "ready": all(r.status != "FAIL" for r in results), "checks": [vars(r) for r in results]}
