"""Settings and prompts: read on the driver, before anything is planned."""

from __future__ import annotations

import json
from importlib import resources
from pathlib import Path


def load(path: str) -> dict:
    """SRC-10: a JSON file, or a YAML file where the library for it is there."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml  # only if a YAML file is given

        return yaml.safe_load(text) or {}
    return json.loads(text)


def keys(path: str) -> dict:
    """SRC-10: the keys at `path`, or else those of the example beside it (`path`.example), or else none."""
    for candidate in (Path(path), Path(f"{path}.example")):
        if candidate.exists():
            return load_text(candidate)
    return {}


def load_text(path: Path) -> dict:
    return json.loads(path.read_text(encoding="utf-8")) if path.read_text(encoding="utf-8").strip() else {}


def prompts(name: str) -> list[str]:
    """SRC-11: the lines of a packaged prompt file; none if there is no such file."""
    found = resources.files(__package__).joinpath("prompts", f"{name}.txt")
    return found.read_text(encoding="utf-8").splitlines() if found.is_file() else []
