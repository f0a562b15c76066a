"""Experiment settings: strict sections, ranges, environment overrides."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, get_type_hints

from kiteloom.functions.text import check_run_id

#: Environment variables that take the place of settings.
OVERRIDES = {
    "KITELOOM_ARTIFACT_ROOT": ("paths", "artifact_root"),
    "KITELOOM_DATA_FILE": ("paths", "raw_data_file"),
    "KITELOOM_MODEL_CACHE": ("paths", "model_cache_dir"),
    "KITELOOM_RUN_ID": ("run", "run_id"),
}


def _setting(default: Any = dataclasses.MISSING, low: float | None = None, high: float | None = None, above: float | None = None, below: float | None = None, choices: tuple = ()) -> Any:
    """A field with its range: ``low`` and ``high`` are allowed, ``above`` and ``below`` aren't."""
    meta = {"low": low, "high": high, "above": above, "below": below, "choices": choices}
    if isinstance(default, list):
        return field(default_factory=lambda: list(default), metadata=meta)
    return field(metadata=meta) if default is dataclasses.MISSING else field(default=default, metadata=meta)


class Section:
    """Checks each value when it is set, and the section as a whole once it is built."""

    def __post_init__(self) -> None:
        object.__setattr__(self, "_built", True)
        self.check()

    def check(self) -> None:
        """Rules across fields."""

    def __setattr__(self, name: str, value: Any) -> None:
        spec = type(self).__dataclass_fields__.get(name)
        if spec is None:
            raise ValueError(f"{type(self).__name__} has no setting {name!r}")
        before = getattr(self, name, dataclasses.MISSING)
        object.__setattr__(self, name, self._valid(spec, value))
        if getattr(self, "_built", False):
            try:
                self.check()
            except ValueError:
                object.__setattr__(self, name, before)
                raise

    def _valid(self, spec: dataclasses.Field, value: Any) -> Any:
        where, kind, m = f"{type(self).__name__}.{spec.name}", get_type_hints(type(self))[spec.name], spec.metadata
        if kind in (Path, Path | None):
            return value if value is None and kind is not Path else Path(value)
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        expected = list if kind == list[str] else kind
        if not isinstance(value, expected) or isinstance(value, bool) and expected is not bool:
            raise ValueError(f"{where} must be {getattr(kind, '__name__', kind)}, not {value!r}")
        if m.get("choices") and value not in m["choices"]:
            raise ValueError(f"{where} must be one of {m['choices']}, not {value!r}")
        for rule, broken in (("low", lambda x: value < x), ("high", lambda x: value > x), ("above", lambda x: value <= x), ("below", lambda x: value >= x)):
            if m.get(rule) is not None and broken(m[rule]):
                raise ValueError(f"{where} = {value!r} is out of range ({rule} {m[rule]})")
        return value


@dataclass
class Project(Section):
    name: str = _setting("parallel-corpus")
    task: str = _setting("machine_translation", choices=("machine_translation",))
    direction: str = _setting("source_to_target", choices=("source_to_target",))
    seed: int = _setting(42, low=0)


@dataclass
class Run(Section):
    run_id: str = _setting()
    description: str = _setting("")

    def _valid(self, spec: dataclasses.Field, value: Any) -> Any:
        value = super()._valid(spec, value)
        return check_run_id(value) if spec.name == "run_id" else value


@dataclass
class Paths(Section):
    artifact_root: Path = _setting(Path("artifacts"))
    model_cache_dir: Path = _setting(Path(".cache/models"))
    raw_data_file: Path | None = _setting(None)


@dataclass
class Dataset(Section):
    delimiter: str = _setting("\t")
    encoding: str = _setting("utf-8", choices=("utf-8", "utf-8-sig"))
    source_column: str = _setting("source")
    target_column: str = _setting("target")
    group_column: str = _setting("group_id")
    record_column: str = _setting("record_id")
    train_ratio: float = _setting(0.80, above=0, below=1)
    dev_ratio: float = _setting(0.10, above=0, below=1)
    test_ratio: float = _setting(0.10, above=0, below=1)
    min_text_chars: int = _setting(2, low=1)
    min_source_script_ratio: float = _setting(0.50, low=0, high=1)
    min_length_ratio: float = _setting(0.25, above=0)
    max_length_ratio: float = _setting(2.00, above=0)
    remove_exact_duplicates: bool = _setting(True)

    def check(self) -> None:
        total = self.train_ratio + self.dev_ratio + self.test_ratio
        if abs(total - 1) > 1e-9:
            raise ValueError(f"split ratios must sum to 1, not {total}")
        if self.min_length_ratio >= self.max_length_ratio:
            raise ValueError("min_length_ratio must be less than max_length_ratio")


@dataclass
class Model(Section):
    repo_id: str = _setting("")
    source_language: str = _setting("source")
    target_language: str = _setting("target")
    max_train_tokens: int = _setting(256, low=32, high=4096)
    max_new_tokens: int = _setting(512, low=16, high=4096)
    attention_implementation: str = _setting("sdpa", choices=("sdpa", "eager"))


@dataclass
class Quantization(Section):
    enabled: bool = _setting(True)
    load_in_4bit: bool = _setting(True)
    quant_type: str = _setting("nf4", choices=("nf4", "fp4"))
    double_quant: bool = _setting(True)
    compute_dtype: str = _setting("auto", choices=("auto", "float16", "bfloat16"))

    def check(self) -> None:
        if self.enabled and not self.load_in_4bit:
            raise ValueError("quantized adapters need load_in_4bit")


@dataclass
class Lora(Section):
    rank: int = _setting(8, low=1, high=256)
    alpha: int = _setting(16, low=1)
    dropout: float = _setting(0.05, low=0, below=1)
    bias: str = _setting("none", choices=("none",))
    exclude_name_fragments: list[str] = _setting(["vision", "visual", "image", "audio", "lm_head", "embed_tokens"])


@dataclass
class Training(Section):
    max_steps: int = _setting(10, low=1)
    train_batch_size: int = _setting(1, low=1)
    eval_batch_size: int = _setting(1, low=1)
    gradient_accumulation_steps: int = _setting(4, low=1)
    learning_rate: float = _setting(2e-4, above=0)
    warmup_ratio: float = _setting(0.03, low=0, below=1)
    weight_decay: float = _setting(0.0, low=0)
    gradient_checkpointing: bool = _setting(True)
    optimizer: str = _setting("paged_adamw_8bit", choices=("paged_adamw_8bit",))
    logging_steps: int = _setting(1, low=1)
    evaluation_steps: int = _setting(5, low=1)
    eval_examples: int = _setting(20, low=1)
    save_steps: int = _setting(5, low=1)
    save_total_limit: int = _setting(2, low=1)


@dataclass
class Evaluation(Section):
    bootstrap_samples: int = _setting(200, low=0)
    test_generation_samples: int = _setting(20, low=1)


@dataclass
class Preflight(Section):
    minimum_python: str = _setting("3.10")
    minimum_pyspark: str = _setting("4.0")
    minimum_disk_free_gib: float = _setting(25.0, above=0)


@dataclass
class Experiment(Section):
    """All sections; each must be given."""

    project: Project = _setting()
    run: Run = _setting()
    paths: Paths = _setting()
    dataset: Dataset = _setting()
    model: Model = _setting()
    quantization: Quantization = _setting()
    lora: Lora = _setting()
    training: Training = _setting()
    evaluation: Evaluation = _setting()
    preflight: Preflight = _setting()


def build(raw: Mapping[str, Any]) -> Experiment:
    """Sections from nested mappings; unknown and missing names raise ``ValueError``."""
    sections = get_type_hints(Experiment)
    if unknown := sorted(set(raw) - set(sections)):
        raise ValueError(f"unknown sections: {unknown}")
    if missing := sorted(set(sections) - set(raw)):
        raise ValueError(f"missing sections: {missing}")
    made = {}
    for name, kind in sections.items():
        values = dict(raw[name] or {})
        if unknown := sorted(set(values) - set(kind.__dataclass_fields__)):
            raise ValueError(f"unknown settings in {name}: {unknown}")
        needed = [f.name for f in dataclasses.fields(kind) if f.default is f.default_factory is dataclasses.MISSING]
        if missing := sorted(set(needed) - set(values)):
            raise ValueError(f"missing settings in {name}: {missing}")
        made[name] = kind(**values)
    return Experiment(**made)


def as_dict(settings: Any) -> dict[str, Any]:
    """Nested mappings of plain values."""
    plain = lambda v: as_dict(v) if dataclasses.is_dataclass(v) else str(v) if isinstance(v, Path) else v
    return {f.name: plain(getattr(settings, f.name)) for f in dataclasses.fields(settings)}


def _expanded(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {k: _expanded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_expanded(v) for v in value]
    return os.path.expandvars(value) if isinstance(value, str) else value


def load(path: str | Path) -> Experiment:
    """Settings from a YAML or JSON file: variables expanded, then environment overrides, then checks."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        raw = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("reading YAML needs the yaml package; settings may be JSON instead") from missing
        raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ValueError("the settings file must hold a mapping")
    raw = _expanded(raw)
    for variable, (section, name) in OVERRIDES.items():
        if value := os.environ.get(variable):
            raw.setdefault(section, {})[name] = value
    return build(raw)
