"""Experiments described by a YAML file: what data, which model, how to train. Unknown keys are errors.

A section may be a mapping or the path of a file that holds one, relative to the file that names it.
"""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

from .sources.records import read_selection
from .sources.registry import LOADERS
from .stages import STAGES

REQUIRED = object()

# The keys of an experiment and of its sections, with their defaults.
TOP = {"name": REQUIRED, "stage": REQUIRED, "data": REQUIRED, "model": REQUIRED, "train": {}, "notes": ""}
SECTIONS = {
    "data": {"source": REQUIRED, "split": "train", "limit": None, "loader": {}, "selection": None},
    "model": {
        "name_or_path": REQUIRED, "dtype": "auto", "trust_remote_code": False, "attn_implementation": None, "gradient_checkpointing": False,
        "use_lora": False, "lora_r": 16, "lora_alpha": 32, "lora_dropout": 0.05, "lora_target_modules": None,
    },
    "train": {
        "output_dir": "runs/cpt", "block_size": 1024, "per_device_train_batch_size": 1, "gradient_accumulation_steps": 8, "learning_rate": 2e-5,
        "num_train_epochs": 1.0, "max_steps": -1, "warmup_ratio": 0.03, "weight_decay": 0.0, "lr_scheduler_type": "cosine", "logging_steps": 10,
        "save_steps": 500, "save_total_limit": 2, "seed": 42, "drop_remainder": True, "report_to": "none", "max_length": 1024, "include_rationale": False,
    },
}


def _mapping(path: Path) -> dict:
    try:
        import yaml
    except ModuleNotFoundError as gone:
        raise RuntimeError("experiments need PyYAML") from gone
    if not path.exists():
        raise FileNotFoundError(f"there is no {path}")
    found = yaml.safe_load(path.read_text())
    if not isinstance(found, dict | None):
        raise ValueError(f"{path} holds no mapping")
    return found or {}


def _filled(given: dict, keys: dict, where: str) -> dict:
    if strange := given.keys() - keys.keys():
        raise ValueError(f"{where} does not know {sorted(strange)}; its keys are {sorted(keys)}")
    if lacking := [k for k, v in keys.items() if v is REQUIRED and k not in given]:
        raise ValueError(f"{where} lacks {lacking}")
    return keys | given


def load(path: str | Path) -> SimpleNamespace:
    """The experiment of a file; each section is filled with its defaults."""
    path = Path(path)
    given = _mapping(path)
    filled = _filled(given, TOP, str(path))
    for name, keys in SECTIONS.items():
        part = filled[name]
        if isinstance(part, str):
            part = _mapping(path.parent / part)
        if not isinstance(part, dict | None):
            raise ValueError(f"{path}: {name} is neither a mapping nor a path")
        filled[name] = SimpleNamespace(**_filled(part or {}, keys, f"{path}: {name}"))
    return SimpleNamespace(**filled)


def as_dict(experiment: SimpleNamespace) -> dict:
    return {k: vars(v) if isinstance(v, SimpleNamespace) else v for k, v in vars(experiment).items()}


def prepare(spark: SparkSession, experiment: SimpleNamespace, tables: str) -> DataFrame:
    """What the experiment's stage reads: the records of its source, those of its selection only, as the stage has them."""
    data, train = experiment.data, experiment.train
    records = LOADERS.get(data.source)(spark, tables, **data.loader)
    if data.limit is not None:
        records = records.orderBy("pos").limit(data.limit)
    selection = None if data.selection is None else read_selection(spark, data.selection)
    own = {"cpt": {"block_size": train.block_size, "keep_rest": not train.drop_remainder}, "sft": {"rationale": train.include_rationale}}
    return STAGES.get(experiment.stage)(records, selection, source=data.source, split=data.split, **own.get(experiment.stage, {}))
