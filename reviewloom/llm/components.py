"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours v. A hot u is pre-aggregated in every task."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_least(both), "u").where(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = down.join(_least(down), "u")
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        linked.select("u", F.col("m").alias("v"))
    )
    return moved.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the least node that u is connected with; nodes that are their own least have no row.

    ``edges`` has nodes ``u`` and ``v`` (long). Each round is written to the shared folder; the rounds end
    when one changes nothing, of which the driver sees a count and a sum.
    """
    edges = written(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == state:
            break
        state = after
    return edges
