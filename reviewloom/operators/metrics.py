"""Per-file measures and risk.  Each is one projection over the files: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import rules
from reviewloom.functions.lookup import language
from reviewloom.functions.text import (
    complexity_of_code,
    complexity_of_file,
    line_count,
    non_blank_lines,
)
from reviewloom.operators.scan import findings_array, level_counts, levels_found


def pr_file_metrics(pr_files: DataFrame, with_findings: bool = False) -> DataFrame:
    """Measures of the changed files of pull requests, taken from their patches.

    ``with_findings`` adds the findings themselves, ``sec`` and ``perf``; the counts are then taken from them.
    """
    patch = "coalesce(patch, '')"
    packs = {"sec": rules.PR_SECURITY, "perf": rules.PR_PERFORMANCE}
    plain = [
        "analysis_id",
        "file_ord",
        "path",
        "additions",
        "deletions",
        language(F.col("path")).alias("language"),
        complexity_of_file(F.expr(patch)).alias("complexity"),
    ]
    if with_findings:
        found = pr_files.select(*plain, *[findings_array(patch, pack).alias(kind) for kind, pack in packs.items()])
        measured = found.select("*", *[c for kind in packs for c in levels_found(F.col(kind), kind)])
    else:
        measured = pr_files.select(*plain, *[c for kind, pack in packs.items() for c in level_counts(patch, pack, kind)])
    return measured.withColumn("risk", _pr_risk())


def _pr_risk() -> Column:
    churn, complexity = F.col("additions") + F.col("deletions"), F.col("complexity")
    n_security = F.col("sec_critical") + F.col("sec_high") + F.col("sec_medium") + F.col("sec_low")
    return (
        F.when((F.col("sec_critical") > 0) | ((complexity > 85) & (churn > 100)), "critical")
        .when(
            (F.col("sec_high") > 0) | (F.col("perf_high") > 0) | (complexity > 70) | (churn > 200),
            "high",
        )
        .when((complexity > 50) | (churn > 50) | (n_security > 0), "medium")
        .otherwise("low")
    )


def repo_file_metrics(contents: DataFrame, *extra: Column, with_findings: bool = False) -> DataFrame:
    """Measures of scanned repository files; their churn is estimated from size and complexity.

    ``extra`` columns over ``content`` are worked out in the same pass.  ``with_findings`` adds the findings
    themselves, ``found``; the counts are then taken from them.
    """
    text, pack = F.col("content"), rules.REPO_SECURITY
    plain = [
        "analysis_id",
        "file_ord",
        "path",
        language(F.col("path")).alias("language"),
        line_count(text).alias("lines"),
        complexity_of_file(text).alias("complexity"),
    ]
    if with_findings:
        found = contents.select(*plain, *extra, findings_array("content", pack).alias("found"))
        measured = found.select("*", *levels_found(F.col("found"), "sec"))
    else:
        measured = contents.select(*plain, *level_counts("content", pack, "sec"), *extra)
    risk = (
        F.when(F.col("sec_critical") > 0, "critical")
        .when(F.col("sec_high") > 0, "high")
        .when(F.col("sec_medium") > 0, "medium")
        .otherwise("low")
    )
    added = F.floor(F.col("lines") * F.lit(0.3)) + F.floor(F.col("complexity") / 5)
    return measured.select(
        "*",
        added.cast("int").alias("additions"),
        F.floor(F.col("lines") * F.lit(0.1)).cast("int").alias("deletions"),
        risk.alias("risk"),
    )


def diff_file_metrics(files: DataFrame) -> DataFrame:
    """Measures of the files of a diff (see ``diffs.diff_files``)."""
    return files.select(
        *[c for c in files.columns if c != "code"],
        *level_counts("code", rules.DIFF_SECURITY, "sec"),
        *level_counts("code", rules.DIFF_PERFORMANCE, "perf"),
    )


def paste_path() -> Column:
    """The file name of pasted code; without one, or with an empty one, a fixed value."""
    return F.when(F.col("filename") != "", F.col("filename")).otherwise("pasted-code")


def paste_language() -> Column:
    """The language of pasted code by its file name; without one that of a text file."""
    return F.when(F.col("filename") != "", language(F.col("filename"))).otherwise("TXT")


def code_metrics(submissions: DataFrame, *extra: Column) -> DataFrame:
    """Measures of pasted code (analysis_id, code, filename); each submission is one file.

    ``extra`` columns over the submission are worked out in the same pass.
    """
    code = F.col("code")
    return submissions.select(
        "analysis_id",
        paste_path().alias("path"),
        paste_language().alias("language"),
        non_blank_lines(code).cast("int").alias("additions"),
        complexity_of_code(code).alias("complexity"),
        *level_counts("code", rules.CODE_SECURITY, "sec"),
        *level_counts("code", rules.CODE_PERFORMANCE, "perf"),
        *extra,
    )


def paste_files(submissions: DataFrame) -> DataFrame:
    """Pasted code as the one added file and the one hunk that it is."""
    code, lines = F.col("code"), F.col("additions")
    measured = submissions.select(
        "analysis_id",
        paste_path().alias("path"),
        paste_language().alias("language"),
        complexity_of_code(code).alias("complexity"),
        F.inline(F.array(F.struct(non_blank_lines(code).cast("int").alias("additions"), code.alias("content")))),
    )
    return measured.select(
        "analysis_id", "path", F.lit("added").alias("status"), "additions", F.lit(0).alias("deletions"),
        "language", "complexity", F.lit(1).alias("old_start"), F.lit(0).alias("old_lines"),
        F.lit(1).alias("new_start"), lines.alias("new_lines"), "content",
    )
