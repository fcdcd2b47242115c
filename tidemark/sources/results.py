"""Result files: JSON without bare NaN."""

from __future__ import annotations

import json
import math
from pathlib import Path


def plain(x):
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def write_json(path: Path, payload: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(plain(payload), indent=2, default=str) + "\n")


def read_json(path: Path) -> dict:
    return json.loads(path.read_text()) if path.exists() else {}
