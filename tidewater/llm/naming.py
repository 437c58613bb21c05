"""Names for helper columns that no column of the input has, in whatever case."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """Each wanted name, with as many underscores behind it as make it new; Spark's names ignore case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
