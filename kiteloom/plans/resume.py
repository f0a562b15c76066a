"""Where a training run goes on: its newest whole checkpoint, under the settings it began with, or with more steps."""

from __future__ import annotations

from typing import Any

from kiteloom.control import checkpoints, config
from kiteloom.control.config import Experiment
from kiteloom.control.run import Layout, logger, manifest, write_manifest
from kiteloom.sources.readers import file_digest, read_json


def resume(settings: Experiment, extend: bool = False) -> dict[str, Any]:
    """Says what a trainer is to do next: begin, resume or nothing, with the checkpoint and the number of steps.

    A run that begins stores its fingerprint. One that goes on must have the same
    settings and data; ``extend`` permits a larger number of steps, and keeps the
    adapter as it was before, which the manifest tells. Checkpoints that aren't
    whole and newer than the one taken are moved aside. Without prepared data it
    raises ``FileNotFoundError``, with other settings ``ValueError``.
    """
    layout, log = Layout(settings), logger()
    own = checkpoints.fingerprint(config.as_dict(settings), {f"{s}_sha256": file_digest(layout.split(s)) for s in ("train", "dev")})
    stored, steps = layout.report("training_fingerprint.json"), settings.training.max_steps
    newest, broken = checkpoints.newest(layout.trainer)
    for moved in checkpoints.quarantine(broken, layout.incomplete):
        log.warning("moved aside, not whole: %s", moved)
    if newest is None:
        if stored.exists():
            checkpoints.verify_resume(stored, own)
        else:
            checkpoints.store_fingerprint(stored, own)
        return {"action": "begin", "checkpoint": None, "global_step": 0, "max_steps": steps, "extended_from": None}
    step = checkpoints.describe(newest)["global_step"]
    before = checkpoints.verify_resume(stored, own, allow_extension=extend)
    out = {"action": "resume", "checkpoint": str(newest), "global_step": step, "max_steps": steps, "extended_from": before}
    if step >= steps:
        log.info("all %d steps are done; to train longer, raise training.max_steps and pass --extend", steps)
        return out | {"action": "nothing"}
    if before is not None:
        kept = layout.checkpoints / f"adapter_step_{step}"
        checkpoints.snapshot(newest, kept)
        known = read_json(layout.report("experiment_manifest.json"), lenient=True) or manifest(settings)
        entry = {"from_max_steps": before, "to_max_steps": steps, "resumed_from": newest.name, "preserved_adapter": str(kept)}
        write_manifest(known | {"training_extensions": [*known.get("training_extensions", []), entry]}, layout)
    return out
