"""Decide what each submission is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.dialect import DOT
from reviewloom.functions.text import is_blank, looks_like_diff

# Addresses of pull requests and of repositories.
PULL_URL = r"github\.com/([^/]+)/([^/]+)/pull/(\d+)"
REPO_URL = r"github\.com/([^/]+)/([^/]+)(?:/" + DOT + r"*)?\z"


def url_parts(url: Column) -> Column:
    """(type, owner, repo, pr_number) of an address, or null when it is neither."""
    is_pull, is_repo = url.rlike(PULL_URL), url.rlike(REPO_URL)

    def part(regex: str, group: int) -> Column:
        return F.regexp_extract(url, regex, group)

    pull = F.struct(
        F.lit("pr").alias("type"),
        part(PULL_URL, 1).alias("owner"),
        part(PULL_URL, 2).alias("repo"),
        part(PULL_URL, 3).try_cast("bigint").alias("pr_number"),
    )
    repo = F.struct(
        F.lit("repo").alias("type"),
        part(REPO_URL, 1).alias("owner"),
        part(REPO_URL, 2).alias("repo"),
        F.lit(None).cast("bigint").alias("pr_number"),
    )
    return F.when(is_pull, pull).when(is_repo, repo)


def parse_urls(df: DataFrame, url: str = "url") -> DataFrame:
    parts = df.withColumn("parts", url_parts(F.col(url)))
    return parts.select(*df.columns, "parts.type", "parts.owner", "parts.repo", "parts.pr_number")


def route(submissions: DataFrame) -> DataFrame:
    """Add ``kind`` (code, diff, repo, pr) or, where there is none, ``reject_reason``.

    Code that is not blank comes first, then a diff that looks like one, then the address.
    """
    code, diff, url = F.col("code"), F.col("diff"), F.col("url")
    parsed = submissions.withColumn("target", url_parts(url))
    is_code = code.isNotNull() & ~is_blank(code)
    is_diff = diff.isNotNull() & looks_like_diff(diff)
    no_url = url.isNull() | (url == "")
    target = F.col("target")
    kind = (
        F.when(is_code, "code")
        .when(is_diff, "diff")
        .when(no_url | target.isNull(), F.lit(None))
        .when(target["type"] == "repo", "repo")
        .when(target["pr_number"] != 0, "pr")
    )
    reason = (
        F.when(is_code | is_diff, F.lit(None))
        .when(no_url, "no url or diff")
        .when(target.isNull(), "not recognised")
        .when((target["type"] == "pr") & (target["pr_number"] == 0), "undetermined")
    )
    return parsed.withColumn("kind", kind).withColumn("reject_reason", reason)
