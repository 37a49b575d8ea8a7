"""The two levels of aggregation: a child place and the parent that holds it."""

from __future__ import annotations

LEVELS = {"parent": "parent", "state": "parent", "child": "child", "county": "child"}


def parse_level(level: str) -> str:
    try:
        return LEVELS[level.lower()]
    except (KeyError, AttributeError):
        raise ValueError(f"level must be 'parent'/'state' or 'child'/'county', got {level!r}") from None
