"""Settings from the environment, checked before a plan is built."""

from __future__ import annotations

import math
import os

_YES = ("1", "true", "yes", "on")


def flag(name: str) -> bool:
    """On only if it says so."""
    return os.environ.get(name, "").strip().lower() in _YES


def path(name: str, default: str) -> str:
    return os.environ.get(name, "").strip() or default


def max_distance(name: str = "LEXMILL_MAX_DISTANCE") -> float | None:
    """None if blank; else a number in (0, 2], or an error that names the variable."""
    raw = os.environ.get(name, "").strip()
    if not raw:
        return None
    try:
        value = float(raw)
    except ValueError:
        value = math.nan
    if not 0 < value <= 2:
        raise ValueError(f"{name} must be a number above 0 and up to 2, not {raw!r}")
    return value
