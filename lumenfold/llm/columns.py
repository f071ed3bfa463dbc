"""Names for an operator's own columns that no input column has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many ``_`` behind it as it takes to clash with none of ``taken`` (whatever the case)."""
    lower = {t.lower() for t in taken}
    found = []
    for name in names:
        while name.lower() in lower:
            name += "_"
        lower.add(name.lower())
        found.append(name)
    return found


def others(columns: Iterable[str], *results: str) -> list[str]:
    """The input's columns but those that the results replace."""
    lower = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in lower]


def quoted(name: str) -> str:
    """``name`` as a column reference, whatever dots or ticks it has."""
    return "`" + name.replace("`", "``") + "`"
