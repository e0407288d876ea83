"""Positions within groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Files per block: a task ranks the rows of one block, never of a whole group.
BLOCK = 4096


def positions_in_group(
    df: DataFrame, group: list[str], along: list[str], order: list[str], leads: dict[str, list[str]]
) -> DataFrame:
    """Add 1-based positions of each row in its group, one per entry of ``leads``.

    Position ``name`` goes by ``leads[name]``, then ``order``; ``along`` are the integer columns
    that ``order`` starts with.  The last of them is cut into blocks; rows are numbered inside
    their (lead, values, block), and running sums over the counts, level by level, give each
    block its offset.  ``df`` is read once per position more, so pass it for reuse.
    """
    blocked = blocks_along(df, along)
    levels = [f"level_{i}" for i in range(len(along))]
    out = blocked
    for name, lead in leads.items():
        keys = [*group, *lead, *levels]
        counts = blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        out = out.withColumn(name, local)
        for depth in range(len(levels), 0, -1):
            inner = [*group, *lead, *levels[:depth]]
            counts = counts.groupBy(*inner).agg(F.sum("rows").alias("rows"))
            within = [*group, *lead, *levels[: depth - 1]] if depth > 1 else group
            sequence = [levels[depth - 1]] if depth > 1 else [*lead, levels[0]]
            before = (
                Window.partitionBy(*within)
                .orderBy(*sequence)
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            offsets = counts.select(*inner, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
            out = (
                out.join(offsets, inner)
                .withColumn(name, (F.col("offset") + F.col(name)).cast("int"))
                .drop("offset")
            )
    return out.select(*df.columns, *leads)


def blocks_along(df: DataFrame, along: list[str]) -> DataFrame:
    """Add ``level_0`` ..: the columns of ``along``, the last one in blocks."""
    levels = {f"level_{i}": F.col(c) for i, c in enumerate(along)}
    levels[f"level_{len(along) - 1}"] = F.floor(F.col(along[-1]) / BLOCK)
    return df.withColumns(levels)


def first_of_group(df: DataFrame, group: list[str], order: list, n: int | None, name: str) -> DataFrame:
    """The first ``n`` rows of each group with their position; each task keeps at most ``n``.

    Without ``n`` all rows, for groups known to be small.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col(name) <= n)
