"""Rollups: churn, languages, folders and short lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.lookup import color, language
from reviewloom.operators.ranking import first_of_group


def churn_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("analysis_id").agg(
        F.sum("additions").cast("bigint").alias("total_additions"),
        F.sum("deletions").cast("bigint").alias("total_deletions"),
        F.count(F.lit(1)).alias("files_changed"),
    )


def language_stats(languages: DataFrame, n: int | None = None) -> DataFrame:
    """The ``n`` languages with most bytes of each repository (all by default), with share and colour.

    ``languages`` has (analysis_id, lang_ord, language, bytes).
    """
    totals = languages.groupBy("analysis_id").agg(F.greatest(F.sum("bytes"), F.lit(1)).alias("total"))
    share = F.floor(F.col("bytes") / F.col("total") * 100 * 10 + F.lit(0.5)) / 10
    top = first_of_group(languages, ["analysis_id"], [F.desc("bytes"), "lang_ord"], n, "rank")
    return top.join(totals, "analysis_id").select(
        "analysis_id",
        "rank",
        "language",
        F.col("bytes").cast("bigint").alias("bytes"),
        share.cast("double").alias("percentage"),
        color(F.col("language")).alias("color"),
    )


def folder_tree(files: DataFrame) -> DataFrame:
    """Folders and files as an adjacency table, with the number of children of each node.

    ``files`` has (analysis_id, file_ord, path, size).  A node keeps the type of the file
    that first needed it, so a file and a folder of one name are one node.
    """
    parts = F.split("path", "/", -1)
    prefixes = files.select(
        "analysis_id",
        "file_ord",
        "size",
        parts.alias("parts"),
        F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"),
    )
    is_file = F.col("depth") == F.size("parts")
    name = F.element_at("parts", F.col("depth"))
    steps = prefixes.select(
        "analysis_id",
        F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"),
        F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/").alias("parent"),
        "depth",
        "file_ord",
        F.struct(
            name.alias("name"),
            F.when(is_file, "file").otherwise("folder").alias("node_type"),
            F.when(is_file, language(name)).alias("language"),
            F.when(is_file, F.col("size")).alias("size"),
        ).alias("node"),
    )
    nodes = steps.groupBy("analysis_id", "path", "parent", "depth").agg(
        F.min_by("node", "file_ord").alias("node")
    )
    # Each node tells of itself and adds one child to its parent, so one more grouping does.
    no_node = F.lit(None).cast(nodes.schema["node"].dataType)
    told = nodes.select(
        "analysis_id",
        F.inline(
            F.array(
                F.struct(
                    "path", "parent", "depth", "node", F.lit(0).alias("children")
                ),
                F.struct(
                    F.col("parent").alias("path"),
                    F.lit(None).cast("string").alias("parent"),
                    F.lit(None).cast("int").alias("depth"),
                    no_node.alias("node"),
                    F.lit(1).alias("children"),
                ),
            )
        ),
    )
    whole = told.groupBy("analysis_id", "path").agg(
        F.max("parent").alias("parent"),
        F.max("depth").alias("depth"),
        F.max("node").alias("node"),
        F.sum("children").cast("int").alias("child_count"),
    )
    return whole.select(
        "analysis_id",
        "path",
        "parent",
        F.coalesce("node.name", F.lit("/")).alias("name"),
        F.coalesce("node.node_type", F.lit("folder")).alias("node_type"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        "child_count",
        "node.language",
        "node.size",
    )


def sibling_order() -> list:
    """Order of the nodes of one folder: folders first, then by name as people sort it."""
    return [F.desc("node_type"), F.collate("name", "UNICODE")]


def listed(tree: DataFrame) -> DataFrame:
    """The whole tree in display order, sorted by range over the cluster."""
    return tree.orderBy("analysis_id", "parent", *sibling_order())


def first_findings(findings: DataFrame, order: list, n: int) -> DataFrame:
    return first_of_group(findings, ["analysis_id"], order, n, "pos")


def first_root_nodes(tree: DataFrame, n: int) -> DataFrame:
    roots = tree.filter(F.col("depth") == 1)
    return first_of_group(roots, ["analysis_id"], sibling_order(), n, "pos")


def first_files(pr_files: DataFrame, n: int) -> DataFrame:
    return first_of_group(
        pr_files.select("analysis_id", "file_ord", "path", "additions", "deletions"),
        ["analysis_id"],
        ["file_ord"],
        n,
        "pos",
    )
