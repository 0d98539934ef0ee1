"""Results as plain rows."""

from __future__ import annotations


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def row_set(df) -> set[tuple]:
    found = rows(df)
    assert len(set(found)) == len(found)
    return set(found)
