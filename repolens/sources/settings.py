"""Settings of a project, one JSON file for each project below a common folder."""

from __future__ import annotations

import hashlib
import json
import os


def _path(folder: str, root: str) -> str:
    return os.path.join(folder, hashlib.md5(os.path.abspath(root).encode()).hexdigest(), "settings.json")


def load(folder: str, root: str) -> dict:
    """What is kept for a project; nothing where there is none, or where the file is broken."""
    try:
        with open(_path(folder, root), encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def save(folder: str, root: str, **values) -> dict:
    """Add values to what is kept; None removes one. The file is replaced as a whole."""
    kept = {k: v for k, v in {**load(folder, root), **values}.items() if v is not None}
    path = _path(folder, root)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(kept, f, indent=1, sort_keys=True)
    os.replace(path + ".new", path)
    return kept


def clear(folder: str, root: str) -> None:
    if os.path.exists(path := _path(folder, root)):
        os.remove(path)
