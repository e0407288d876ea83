"""Which files of a repository or pull request are kept, and which are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.lookup import ASSET_EXTENSIONS, SOURCE_EXTENSIONS, extension, language
from reviewloom.operators.ranking import first_of_group

MAX_SCANNED_SIZE = 500_000
FILES_PER_REPO = 15
FILES_PER_PR = 20


def tree_blobs(tree: DataFrame) -> DataFrame:
    return tree.filter(F.col("type") == "blob")


def is_repo_file(path: Column) -> Column:
    ext = extension(path)
    return (ext != "") & ~ext.isin(ASSET_EXTENSIONS)


def repo_files(tree: DataFrame) -> DataFrame:
    """Blobs that are not assets, with their size (0 when unknown) and language."""
    path = F.col("path")
    return tree_blobs(tree).filter(is_repo_file(path)).select(
        "analysis_id",
        "file_ord",
        "path",
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        language(path).alias("language"),
    )


def scan_candidates(tree: DataFrame, n: int = FILES_PER_REPO) -> DataFrame:
    """The ``n`` largest source files of each repository, in scan order."""
    size = F.coalesce("size", F.lit(0)).cast("bigint")
    sources = (
        tree_blobs(tree)
        .filter(extension(F.col("path")).isin(SOURCE_EXTENSIONS) & (size < MAX_SCANNED_SIZE))
        .select("analysis_id", "file_ord", "path", size.alias("size"))
    )
    return first_of_group(sources, ["analysis_id"], [F.desc("size"), "file_ord"], n, "scan_ord")


def pr_candidates(pr_files: DataFrame, n: int = FILES_PER_PR) -> DataFrame:
    """The ``n`` most changed files with a patch of each pull request, in fetch order."""
    patched = pr_files.filter(F.col("patch").isNotNull() & (F.col("patch") != "")).select(
        "analysis_id", "file_ord", "path", "changes"
    )
    return first_of_group(patched, ["analysis_id"], [F.desc("changes"), "file_ord"], n, "scan_ord")


def blocking(df: DataFrame, level: str = "level") -> DataFrame:
    """Findings or review items that are critical or high."""
    return df.filter(F.col(level).isin("critical", "high"))
