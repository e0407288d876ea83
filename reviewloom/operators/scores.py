"""Scores per analysis, from sums over its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.lookup import complexity_band, round_half_up, score_band

# Average complexity taken where an analysis has no file.
NO_FILES = {"pr": 0.0, "repo": 20.0, "diff": 10.0}
VERY_COMPLEX, COMPLEX = 85, 70


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")


def _clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def file_sums(metrics: DataFrame, kind: str) -> DataFrame:
    """Per analysis: files, churn, average complexity and findings by level.

    All of it combines partially before the shuffle, so a hot analysis is no burden.
    """
    levels = [c for c in metrics.columns if c.startswith(("sec_", "perf_"))]
    return metrics.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        _sum("additions").alias("additions"),
        _sum("deletions").alias("deletions"),
        F.coalesce(
            F.sum("complexity").cast("double") / F.count("complexity"), F.lit(NO_FILES[kind])
        ).alias("avg_complexity"),
        F.count_if(F.col("complexity") > VERY_COMPLEX).alias("n_very_complex"),
        F.count_if(F.col("complexity") > COMPLEX).alias("n_complex"),
        *[_sum(c).alias(c) for c in levels],
    )


def with_all(analyses: DataFrame, sums: DataFrame, kind: str) -> DataFrame:
    """Sums for every analysis, also those without a file."""
    joined = analyses.select("analysis_id").join(sums, "analysis_id", "left")
    zeros = {c: 0 for c in sums.columns if c not in ("analysis_id", "avg_complexity")}
    return joined.fillna({**zeros, "avg_complexity": NO_FILES[kind]})


def _security(low: int = 2) -> Column:
    cost = (
        20 * F.col("sec_critical")
        + 10 * F.col("sec_high")
        + 5 * F.col("sec_medium")
        + low * F.col("sec_low")
    )
    return _clamp(100 - cost)


def _complexity() -> Column:
    return _clamp(F.lit(100) - F.col("avg_complexity") + F.lit(20))


def _maintainability(significant: Column, by_complexity: bool = True) -> Column:
    score = 85 - 6 * F.least(significant, F.lit(5))
    if by_complexity:
        avg = F.col("avg_complexity")
        score = score - F.when(avg > 80, 12).when(avg > 60, 5).otherwise(0)
    return _clamp(score, low=20)


def _rounded(df: DataFrame, names: list[str], keep: list[str] = ()) -> DataFrame:
    return df.select("analysis_id", *[round_half_up(F.col(n)).alias(n) for n in names], *keep)


def scores_pr(sums: DataFrame, coupled: DataFrame) -> DataFrame:
    """Scores of pull requests.  ``coupled`` has one row per coupled file (``graph.coupling``)."""
    n_coupled = coupled.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n_coupled"))
    df = sums.join(n_coupled, "analysis_id", "left")
    significant = F.col("n_very_complex") + F.coalesce("n_coupled", F.lit(0))
    performance = 100 - (
        15 * F.col("perf_high") + 8 * F.col("perf_medium") + 3 * F.col("perf_low")
    )
    parts = df.select(
        "analysis_id",
        _security().alias("security"),
        _clamp(performance).alias("performance"),
        _complexity().alias("complexity"),
        _maintainability(significant).alias("maintainability"),
    )
    overall = (
        F.col("security") * F.lit(0.3)
        + F.col("performance") * F.lit(0.25)
        + F.col("complexity") * F.lit(0.25)
        + F.col("maintainability") * F.lit(0.2)
    )
    names = ["overall", "security", "performance", "complexity", "maintainability"]
    return _rounded(parts.withColumn("overall", overall), names)


def scores_repo(sums: DataFrame, n_repo_files: DataFrame) -> DataFrame:
    """Scores of repositories.  ``n_repo_files`` counts all their files, scanned or not."""
    df = sums.join(n_repo_files, "analysis_id", "left")
    significant = F.col("n_very_complex")
    total = F.least(F.coalesce("total_files", F.lit(0)), F.lit(100))
    architecture = F.lit(80) - total * F.lit(0.15) - significant * 5
    parts = df.select(
        "analysis_id",
        _security().alias("security"),
        _complexity().alias("complexity"),
        _maintainability(significant).alias("maintainability"),
        _clamp(architecture, low=30).alias("architecture"),
    )
    overall = (
        F.col("security") * F.lit(0.3)
        + F.col("complexity") * F.lit(0.25)
        + F.col("maintainability") * F.lit(0.25)
        + F.col("architecture") * F.lit(0.2)
    )
    names = ["overall", "security", "complexity", "maintainability", "architecture"]
    return _rounded(parts.withColumn("overall", overall), names)


def scores_diff(sums: DataFrame) -> DataFrame:
    """Scores of diffs.  No item of a diff's queue takes significant effort, and low findings are free."""
    parts = sums.select(
        "analysis_id",
        _security(low=0).alias("security"),
        _complexity().alias("complexity"),
        _maintainability(F.lit(0), by_complexity=False).alias("maintainability"),
    )
    overall = (
        F.col("security") * F.lit(0.3)
        + F.col("complexity") * F.lit(0.3)
        + F.col("maintainability") * F.lit(0.4)
    )
    names = ["overall", "security", "complexity", "maintainability"]
    return _rounded(parts.withColumn("overall", overall), names)


def code_score_columns() -> dict[str, Column]:
    """Scores of pasted code as columns over its measures."""
    n_sec = F.col("sec_critical") + F.col("sec_high") + F.col("sec_medium") + F.col("sec_low")
    n_perf = F.col("perf_high") + F.col("perf_medium") + F.col("perf_low")
    simple = F.greatest(F.lit(0), 100 - F.col("complexity")).cast("int")
    overall = 100 - 15 * n_sec - 5 * n_perf - F.when(F.col("complexity") > COMPLEX, 15).otherwise(0)
    security = 100 - 25 * F.col("sec_critical") - 10 * F.col("sec_high")
    return {
        "overall": F.greatest(F.lit(10), overall).cast("int"),
        "security": F.greatest(F.lit(0), security).cast("int"),
        "complexity": simple,
        "maintainability": simple,
    }


def scores_code(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "analysis_id", *[c.alias(name) for name, c in code_score_columns().items()]
    )


def average_complexity(sums: DataFrame) -> DataFrame:
    """Average complexity as used by the scores, and as shown: rounded, 0 without files."""
    shown = F.when(F.col("n_files") > 0, round_half_up(F.col("avg_complexity"))).otherwise(0)
    return sums.select("analysis_id", "n_files", "avg_complexity", shown.cast("int").alias("shown"))


def severity_counts(metrics: DataFrame) -> DataFrame:
    """Findings by level and the number of files that have any, for both kinds."""
    def per_kind(prefix: str) -> list[Column]:
        levels = [c for c in metrics.columns if c.startswith(prefix)]
        any_of = sum((F.col(c) for c in levels), F.lit(0))
        return [
            *[_sum(c).alias(c) for c in levels],
            F.count_if(any_of > 0).alias(f"{prefix}files"),
        ]

    return metrics.groupBy("analysis_id").agg(*per_kind("sec_"), *per_kind("perf_"))


def threat_level(sums: DataFrame) -> DataFrame:
    level = (
        F.when(F.col("sec_critical") > 0, "Critical")
        .when(F.col("sec_high") > 0, "High")
        .when(F.col("sec_medium") > 0, "Medium")
        .otherwise("Clean")
    )
    return sums.select("analysis_id", level.alias("threat_level"))


def impact_level(sums: DataFrame) -> DataFrame:
    level = (
        F.when(F.col("perf_high") > 0, "High")
        .when(F.col("perf_medium") > 0, "Medium")
        .when(F.col("perf_low") > 0, "Low")
        .otherwise("Optimal")
    )
    return sums.select("analysis_id", level.alias("impact_level"))


def score_bands(scores: DataFrame) -> DataFrame:
    """Each score in long form with its band."""
    names = [c for c in scores.columns if c != "analysis_id"]
    long = scores.unpivot("analysis_id", names, "score_name", "score")
    return long.withColumn("band", score_band(F.col("score")))


def complexity_bands(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "analysis_id", "path", "complexity", complexity_band(F.col("complexity")).alias("band")
    )


def review_estimate(sums: DataFrame, scores: DataFrame, queue: DataFrame) -> DataFrame:
    """Minutes a review should take, the same as text, and the number of quick fixes.

    ``queue`` has the counts n_critical, n_high and n_quick of each review queue.
    """
    df = (
        sums.select("analysis_id", "additions", "deletions")
        .join(scores.select("analysis_id", "complexity"), "analysis_id")
        .join(queue, "analysis_id", "left")
        .fillna(0)
    )
    base = F.ceil((F.col("additions") + F.col("deletions")) / 15)
    weight = (100 - F.col("complexity")) / F.lit(100.0)
    minutes = F.greatest(
        F.lit(15), base + 25 * F.col("n_critical") + 12 * F.col("n_high") + F.ceil(base * weight)
    )
    timed = df.select("analysis_id", minutes.cast("bigint").alias("minutes"), "n_quick")
    hours, rest = F.floor(F.col("minutes") / 60), F.col("minutes") % 60
    text = (
        F.when(F.col("minutes") < 60, F.concat("minutes", F.lit("m")))
        .when(rest > 0, F.concat(hours, F.lit("h "), rest, F.lit("m")))
        .otherwise(F.concat(hours, F.lit("h")))
    )
    return timed.select("analysis_id", "minutes", text.alias("estimate"), "n_quick")
