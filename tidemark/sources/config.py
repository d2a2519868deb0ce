"""Strict settings: known keys with types and defaults; anything else is an error. JSON files, and YAML where it is installed."""

from __future__ import annotations

import json
from dataclasses import MISSING, fields, is_dataclass
from pathlib import Path
from typing import Any, TypeVar, get_type_hints

T = TypeVar("T")


def parse(kind: type[T], raw: dict[str, Any], where: str = "settings") -> T:
    """An instance of the dataclass from a mapping; nested dataclasses are parsed alike."""
    if not isinstance(raw, dict):
        raise ValueError(f"{where}: a mapping is wanted")
    types = get_type_hints(kind)
    known = {f.name: f for f in fields(kind)}
    unknown, missing = set(raw) - set(known), [n for n, f in known.items() if n not in raw and f.default is MISSING and f.default_factory is MISSING]
    if unknown or missing:
        raise ValueError(f"{where}: unknown keys {sorted(unknown)}, missing keys {missing}")
    out = {}
    for name, value in raw.items():
        wanted = types[name]
        if is_dataclass(wanted):
            value = parse(wanted, value, f"{where}.{name}")
        elif wanted is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        elif isinstance(wanted, type) and (not isinstance(value, wanted) or (wanted is int and isinstance(value, bool))):
            raise ValueError(f"{where}.{name}: {wanted.__name__} is wanted, not {value!r}")
        out[name] = value
    return kind(**out)


def load(kind: type[T], path: str) -> T:
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("YAML settings need the yaml package; JSON needs none") from missing
        return parse(kind, yaml.safe_load(text), path)
    return parse(kind, json.loads(text), path)
