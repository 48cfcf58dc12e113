"""Configurations as nested dicts."""

from __future__ import annotations

import json
from pathlib import Path


def load_config(path: str | Path) -> dict:
    """A JSON or YAML file (YAML where a reader of it is installed)."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml  # only needed here

    return yaml.safe_load(text)


def section(config: dict, name: str) -> dict:
    """One block of a config; a KeyError names the blocks that there are."""
    if name not in config:
        raise KeyError(f"no {name!r}; the config has {sorted(config)}")
    return config[name]


def general_eval_section(config: dict) -> dict:
    return section(config, "general_lm_eval")


def checkpoint_of(config: dict, condition: str, root: str = ".") -> str:
    """The checkpoint folder of a condition; an unknown one is an error that names the known ones."""
    known = {c["id"]: c["checkpoint"] for c in section(config, "conditions")}
    if condition not in known:
        raise ValueError(f"unknown condition {condition!r}; known are {sorted(known)}")
    return f"{root.rstrip('/')}/{known[condition]}"
