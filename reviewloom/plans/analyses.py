"""Whole analyses: from inputs to one result row each.

Every function takes tables of many analyses and returns lazy DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import imports_of_repo_file
from reviewloom.operators import diffs, graph, metrics, narrative, reviews, scores
from reviewloom.session import reuse

RESULT = [
    "analysis_id", "kind", "overall", "security", "complexity", "maintainability",
    "performance", "architecture", "files_changed", "total_additions", "total_deletions", "summary",
]


def _result(df: DataFrame, kind: str) -> DataFrame:
    """The common result row; scores a kind does not have are null."""
    df = df.withColumn("kind", F.lit(kind))
    missing = {c: F.lit(None).cast("int") for c in RESULT if c not in df.columns}
    return df.withColumns(missing).select(*RESULT)


def totals(sums: DataFrame) -> DataFrame:
    return sums.select(
        "analysis_id",
        F.col("n_files").alias("files_changed"),
        F.col("additions").alias("total_additions"),
        F.col("deletions").alias("total_deletions"),
    )


def diff_sums(submissions: DataFrame) -> DataFrame:
    """Sums over the files of each diff, also of those without any."""
    files = diffs.diff_files(diffs.file_blocks(submissions))
    sums = scores.file_sums(metrics.diff_file_metrics(files), "diff")
    # Scores, totals and texts all start from these few numbers.
    return reuse(scores.with_all(submissions, sums, "diff"))


def results_code(submissions: DataFrame) -> DataFrame:
    """Results of pasted code (with ``filename``): one projection over the submissions, no shuffle."""
    df = metrics.code_metrics(submissions).select(
        "analysis_id",
        *[c.alias(name) for name, c in scores.code_score_columns().items()],
        F.lit(1).cast("bigint").alias("files_changed"),
        F.col("additions").cast("bigint").alias("total_additions"),
        F.lit(0).cast("bigint").alias("total_deletions"),
        narrative.code_summary_text().alias("summary"),
    )
    return _result(df, "code")


def results_diff(submissions: DataFrame) -> DataFrame:
    sums = diff_sums(submissions)
    scored = scores.scores_diff(sums)
    texts = narrative.summary_diff(totals(sums), reviews.queue_counts_diff(sums))
    return _result(scored.join(totals(sums), "analysis_id").join(texts, "analysis_id"), "diff")


def pr_parts(pr_files: DataFrame, contents: DataFrame, with_findings: bool = False) -> dict[str, DataFrame]:
    """Measures (with the findings, if asked for), sums, edges, queue counts and scores of pull requests."""
    # The patches are scanned once; all else starts from the narrow measures.
    measured = reuse(metrics.pr_file_metrics(pr_files, with_findings))
    sums = scores.file_sums(measured, "pr")
    edges = graph.edges_pr(graph.imports_pr(contents), pr_files)
    coupled = reuse(graph.coupling(edges))
    return {
        "metrics": measured,
        "sums": sums,
        "edges": edges,
        "coupled": coupled,
        "queue": reviews.queue_counts_pr(sums, coupled),
        "scores": scores.scores_pr(sums, coupled),
        "totals": totals(sums),
    }


def results_pr(pr_files: DataFrame, contents: DataFrame) -> DataFrame:
    p = pr_parts(pr_files, contents)
    texts = narrative.summary_pr(p["totals"], p["queue"], p["metrics"])
    return _result(p["scores"].join(p["totals"], "analysis_id").join(texts, "analysis_id"), "pr")


def repo_parts(
    info: DataFrame, languages: DataFrame, files: DataFrame, contents: DataFrame, with_findings: bool = False
) -> dict[str, DataFrame]:
    """Sums, scores and facts of repositories.

    ``languages`` as from ``rollups.language_stats``, ``files`` from ``selection.repo_files``,
    ``contents`` those of the source files.  ``with_findings`` keeps the findings beside the measures, and ``smaller``,
    a column of ``contents`` that tells their order.
    """
    kept = [imports_of_repo_file(F.col("content")).alias("imports"), *([F.col("smaller")] if with_findings else [])]
    # The contents are scanned once; all else starts from the narrow measures.
    measured = reuse(metrics.repo_file_metrics(contents, *kept, with_findings=with_findings))
    sums = scores.with_all(info, scores.file_sums(measured.drop("imports"), "repo"), "repo")
    counted = files.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("total_files"))
    scored = scores.scores_repo(sums, counted)
    edges = graph.edges_repo(graph.exploded_imports(measured, F.col("imports")), files)
    n_edges = edges.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n_edges"))
    facts = narrative.repo_facts(info, languages, sums, counted, scored, n_edges)
    return {"metrics": measured, "sums": sums, "scores": scored, "facts": facts}


def results_repo(
    info: DataFrame, languages: DataFrame, files: DataFrame, contents: DataFrame
) -> DataFrame:
    p = repo_parts(info, languages, files, contents)
    texts = narrative.summary_repo(p["facts"])
    df = p["scores"].join(totals(p["sums"]), "analysis_id").join(texts, "analysis_id")
    return _result(df, "repo")
