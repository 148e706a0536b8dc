"""Run settings from the environment: whole numbers and switches, or an error that names them."""

from __future__ import annotations

import os
import re


def positive_int(name: str, default: int) -> int:
    """A whole number from 1 on; unset or empty gives the default."""
    text = os.environ.get(name, "").strip()
    if not text:
        return default
    if not re.fullmatch(r"[0-9]+", text) or int(text) < 1:
        raise ValueError(f"{name} must be a positive whole number, not {text!r}")
    return int(text)


def switch(name: str, default: bool = False) -> bool:
    """true/yes/1 or false/no/0 in any case; unset or empty gives the default."""
    text = os.environ.get(name, "").strip().lower()
    if not text:
        return default
    if text not in ("1", "true", "yes", "0", "false", "no"):
        raise ValueError(f"{name} must be true or false, not {text!r}")
    return text in ("1", "true", "yes")
