"""Small helpers to build expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(value: str) -> str:
    """SQL literal of a string.

    A dollar sign is written as an escape, or the parser would take ``${..}`` for a variable.
    """
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
    return f"'{escaped}'"


def literals(values) -> str:
    """SQL literals of strings, as an argument list."""
    return ", ".join(quoted(v) for v in values)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` uses it.

    Needed inside lambdas, where common subexpressions are not shared.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def when_rows(condition: Column, *columns: Column) -> Column:
    """Generator of one row of ``columns`` where ``condition`` holds.

    Unlike a filter it is not pushed below the projection that made its inputs, so what
    they cost is paid once.
    """
    row = F.array(F.struct(*columns))
    return F.inline(F.when(condition, row).otherwise(F.slice(row, 1, 0)))
