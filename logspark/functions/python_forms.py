"""The same functions on Python values, for SQL registration and as test oracles."""

from __future__ import annotations

import re

from .normalize import BASE, EXTENDED


def _apply(text: str, rules) -> str:
    for pattern, placeholder, ignore_case in rules:
        text = re.sub(pattern, placeholder, text, flags=re.IGNORECASE if ignore_case else 0)
    return re.sub(r"\s+", " ", text).strip()


def normalize(text: str) -> str:
    return _apply(text, BASE)


def normalize_extended(text: str) -> str:
    return _apply(text, EXTENDED)


def fold_level(level: str) -> str:
    level = level.strip().upper()
    return "WARN" if level == "WARNING" else level
