"""Depth-first positions of the nodes of folder trees, of any size, in the order a reader sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.joins import salted_join
from reviewloom.session import landed_table


def _filed_ancestors(tree: DataFrame) -> DataFrame:
    """Depths at which a node's path leads through a node shown as a file: one that was a file before it was a folder."""
    filed = tree.filter((F.col("node_type") == "file") & (F.col("child_count") > 0))
    filed = filed.select("analysis_id", F.col("path").alias("above"))
    parts = F.split("path", "/", -1)
    steps = tree.filter("depth > 1").select(
        "analysis_id", "path", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("at")
    )
    ancestors = steps.select("analysis_id", "path", "at", F.array_join(F.slice("parts", 1, F.col("at")), "/").alias("above"))
    met = salted_join(filed, ancestors, ["analysis_id", "above"], spread_by="path")
    # A path has as many ancestors as it has slashes, so the set is short.
    return met.groupBy("analysis_id", "path").agg(F.collect_set("at").alias("filed"))


def display_positions(tree: DataFrame) -> DataFrame:
    """``folder_tree`` rows with ``pos``: the root is 1, each folder is followed by all that is in it.

    In a folder, nodes shown as folders come first, then by name as people sort it (names that sort alike by their
    code points).  A null analysis_id is an analysis of its own.

    The order of a whole tree is that of one key per node, the steps of its path.  So the rows are sorted by ranges over the
    cluster and written with their place in the range; what lies before a range is a running sum over counts.
    """
    none = F.array().cast("array<int>")
    joined = tree.join(_filed_ancestors(tree), ["analysis_id", "path"], "left").withColumn("filed", F.coalesce("filed", none))
    parts = F.slice(F.split("path", "/", -1), 1, F.col("depth"))

    def step(name, i):
        own = (i + 1 == F.col("depth")) & (F.col("node_type") == "file")
        is_file = own | F.array_contains("filed", i + 1)
        return F.struct(is_file.alias("is_file"), F.collate(name, "UNICODE").alias("name"), name.alias("points"))

    # The root has no steps; a slice of none would be an error only below one.
    key = F.when(F.col("depth") > 0, F.transform(parts, step))
    ordered = joined.withColumn("key", key).orderBy(F.col("analysis_id"), F.col("key").asc_nulls_first()).drop("key", "filed")
    # The upper bits are the number of the range, the lower 33 the place in it.
    placed = landed_table(ordered.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("analysis_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    # A row per range and analysis in it, so an analysis has at most as many as there are ranges.
    before = Window.partitionBy("analysis_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("analysis_id").alias("of"), F.col("part").alias("of_part"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    same = F.col("analysis_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    pos = F.col("offset") + F.col("place") - F.col("first") + 1
    return placed.join(offsets, same).select(*tree.columns, pos.alias("pos"))
