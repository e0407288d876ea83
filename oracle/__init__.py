"""SQL that gives the results of the registered queries in DuckDB, for checking them.

The statements work another way than the Spark jobs: prefix counts instead of marked
lines, theta joins instead of keys, per-line splits instead of one expression.
"""

from __future__ import annotations

import re

from oracle import ctes, selects


def _uses(body: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", body)]


def statement(select: str) -> str:
    """``select`` with the common table expressions it needs, in order."""
    names = list(ctes.CTES)
    needed, todo = set(), _uses(select, names)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [n for n in _uses(ctes.CTES[name], names) if n != name]
    # The recursive one must not work out its successor table at every step.
    once = {"next_event"}
    parts = [
        f"{n} AS {'MATERIALIZED ' if n in once else ''}({ctes.CTES[n]})" for n in names if n in needed
    ]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + select


def oracle_sql() -> dict[str, str]:
    return {key: statement(select) for key, select in selects.SELECTS.items()}
