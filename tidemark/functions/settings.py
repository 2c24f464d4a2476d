"""Settings from the environment: flags, numbers and paths."""

from __future__ import annotations

import os


def flag(name: str, default: bool = False) -> bool:
    """Whether a variable says yes (1, true, yes or on, in any case); the default where it is unset."""
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def whole(name: str, default: int | None = None) -> int | None:
    """A variable's number; none where it is empty or says "none", the default where it is unset."""
    value = os.environ.get(name)
    if value is None:
        return default
    value = value.strip()
    return None if value.lower() in ("", "none") else int(value)


def count(name: str, default: int, least: int = 0) -> int:
    """A variable's number if it is one of at least ``least``, else the default."""
    value = os.environ.get(name, "").strip()
    return int(value) if value.isdigit() and int(value) >= least else default


def expand(path: str) -> str:
    """A path with its variables and home folder filled in."""
    return os.path.expandvars(os.path.expanduser(path))
