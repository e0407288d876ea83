"""Review queues: findings and complaints about files, numbered and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions import rules
from reviewloom.functions.binding import literals
from reviewloom.functions.lookup import basename, rank_of
from reviewloom.functions.rules import CATEGORY_RANK, LEVEL_RANK, Rule
from reviewloom.functions.text import complexity_of_code, complexity_of_file
from reviewloom.operators.metrics import paste_path
from reviewloom.operators.ranking import positions_in_group
from reviewloom.operators.scan import findings_array
from reviewloom.operators.scores import COMPLEX, VERY_COMPLEX
from reviewloom.session import reuse

_ITEM = (
    "struct<category:string,severity:string,line:int,title:string,description:string,"
    "suggestion:string,effort:string,rule_ord:int,match_ord:int>"
)
OUTPUT = [
    "analysis_id", "id", "priority", "category", "severity", "path", "line",
    "title", "description", "suggestion", "effort",
]
_SPLIT_UP = "Split it into smaller functions with less nesting"


def _item(category, severity, line, title, description, suggestion, effort, rule_ord, match_ord):
    return F.struct(
        F.lit(category).alias("category"),
        severity.alias("severity"),
        line.alias("line"),
        title.alias("title"),
        description.alias("description"),
        suggestion.alias("suggestion"),
        effort.alias("effort"),
        rule_ord.alias("rule_ord"),
        match_ord.alias("match_ord"),
    )


def _of_rule(pack: list[Rule], field: str, finding: Column) -> Column:
    """Text of the rule a finding comes from."""
    texts = F.expr(f"array({literals(getattr(r, field) for r in pack)})")
    return F.get(texts, finding["rule_ord"] - 1)


def _finding_items(found: Column, pack: list[Rule], place: Column, kind: str) -> Column:
    """Items for the findings of one file.

    ``kind`` is pr, repo, diff or code.  They differ in titles, efforts and levels.
    """
    category = pack[0].kind

    def item(f: Column) -> Column:
        note, advice = _of_rule(pack, "note", f), _of_rule(pack, "advice", f)
        level = f["level"]
        if category == "security":
            effort = F.when(level == "critical", "quick").otherwise("moderate")
        elif kind == "code":
            effort = F.when(level == "high", "quick").otherwise("moderate")
        else:
            effort = F.when(level == "high", "moderate").otherwise("quick")
        if category == "performance" and kind == "diff":
            level = F.when(level == "high", "high").otherwise("medium")
        if kind == "code":
            title, note = F.concat(f["type"], F.lit(" — "), note), advice
        else:
            title = F.concat(f["type"], F.lit(" in "), place)
        return _item(
            category, level, f["line"], title, note, advice, effort, f["rule_ord"], f["match_ord"]
        )

    return F.transform(found, item)


def _complexity_items(complexity: Column, title: Column) -> Column:
    very = complexity > VERY_COMPLEX
    item = _item(
        "complexity",
        F.when(very, "high").otherwise("medium"),
        F.lit(None).cast("int"),
        title,
        F.concat(F.lit("Complexity of this file is "), complexity),
        F.lit(_SPLIT_UP),
        F.when(very, "significant").otherwise("moderate"),
        F.lit(0),
        F.lit(0),
    )
    none = F.array().cast(f"array<{_ITEM}>")
    return F.when(complexity > COMPLEX, F.array(item)).otherwise(none)


def _ranked(items: DataFrame) -> DataFrame:
    return items.withColumn("sev_rank", rank_of(F.col("severity"), LEVEL_RANK)).withColumn(
        "cat_rank", rank_of(F.col("category"), CATEGORY_RANK)
    )


def _number_small(items: DataFrame, inserted: list[str], ranked: list[str]) -> DataFrame:
    """Ids and priorities where one submission bounds the group."""
    by_analysis = Window.partitionBy("analysis_id")
    return items.select(
        "*",
        F.concat(F.lit("r"), F.row_number().over(by_analysis.orderBy(*inserted))).alias("id"),
        F.row_number().over(by_analysis.orderBy(*ranked)).alias("priority"),
    ).select(*OUTPUT)


def review_items_pr(pr_files: DataFrame, coupled: DataFrame) -> DataFrame:
    """Unnumbered queue items of pull requests, with the keys they are ordered by."""
    patch = "coalesce(patch, '')"
    scanned = pr_files.select(
        "analysis_id",
        "file_ord",
        "path",
        findings_array(patch, rules.PR_SECURITY).alias("sec"),
        findings_array(patch, rules.PR_PERFORMANCE).alias("perf"),
        complexity_of_file(F.expr(patch)).alias("complexity"),
    )
    return items_of_scanned_pr(scanned, coupled)


def items_of_scanned_pr(scanned: DataFrame, coupled: DataFrame) -> DataFrame:
    """The same items from measures that hold the findings (``metrics.pr_file_metrics``)."""
    place = basename(F.col("path"))
    title = F.concat(
        F.lit("Very complex: "), place, F.lit(" (measure "), F.col("complexity"), F.lit(")")
    )
    of_files = scanned.select(
        "analysis_id",
        "file_ord",
        "path",
        F.inline(
            F.concat(
                _finding_items(F.col("sec"), rules.PR_SECURITY, place, "pr"),
                _finding_items(F.col("perf"), rules.PR_PERFORMANCE, place, "pr"),
                _complexity_items(F.col("complexity"), title),
            )
        ),
    )
    n = F.col("n_edges")
    of_graph = (
        coupled.withColumn(
            "item",
            _item(
                "architecture",
                F.col("severity"),
                F.lit(None).cast("int"),
                F.concat(
                    F.lit("Imports much: "), basename(F.col("source")), F.lit(" ("), n,
                    F.lit(" imports)"),
                ),
                F.concat(F.lit("This file imports "), n, F.lit(" of the changed files")),
                F.lit("Put an interface between them"),
                F.lit("significant"),
                F.lit(0),
                F.lit(0),
            ),
        )
        .select(
            "analysis_id", F.col("source_ord").alias("file_ord"), F.col("source").alias("path"), "item.*"
        )
    )
    return _ranked(of_files.unionByName(of_graph))


def reviews_pr(items: DataFrame) -> DataFrame:
    """Number the queue of each pull request, which may have any number of files."""
    numbered = positions_in_group(
        reuse(items),
        ["analysis_id"],
        ["file_ord"],
        ["file_ord", "rule_ord", "match_ord"],
        {"priority": ["sev_rank", "cat_rank"], "number": ["cat_rank"]},
    )
    return numbered.withColumn("id", F.concat(F.lit("r"), "number")).select(*OUTPUT)


def reviews_repo(contents: DataFrame) -> DataFrame:
    """Queue of each repository; its files come in the order of ``smaller``, then of the tree."""
    place = basename(F.col("path"))
    scanned = contents.select(
        "analysis_id",
        "smaller",
        "file_ord",
        "path",
        findings_array("content", rules.REPO_SECURITY).alias("sec"),
        complexity_of_file(F.col("content")).alias("complexity"),
    )
    title = F.concat(
        F.lit("Very complex: "), place, F.lit(" ("), F.col("complexity"), F.lit(")")
    )
    items = scanned.select(
        "analysis_id",
        "smaller",
        "file_ord",
        "path",
        F.inline(
            F.concat(
                _finding_items(F.col("sec"), rules.REPO_SECURITY, place, "repo"),
                _complexity_items(F.col("complexity"), title),
            )
        ),
    )
    numbered = positions_in_group(
        reuse(_ranked(items)),
        ["analysis_id"],
        ["smaller", "file_ord"],
        ["smaller", "file_ord", "cat_rank", "rule_ord", "match_ord"],
        {"priority": ["sev_rank", "cat_rank"], "number": []},
    )
    return numbered.withColumn("id", F.concat(F.lit("r"), "number")).select(*OUTPUT)


def reviews_diff(files: DataFrame) -> DataFrame:
    """Queue of each diff (files as from ``diffs.diff_files``); ranked by severity alone."""
    place = basename(F.col("path"))
    scanned = files.select(
        "analysis_id",
        "file_ord",
        "path",
        findings_array("code", rules.DIFF_SECURITY).alias("sec"),
        findings_array("code", rules.DIFF_PERFORMANCE).alias("perf"),
    )
    items = scanned.select(
        "analysis_id",
        "file_ord",
        "path",
        F.inline(
            F.concat(
                _finding_items(F.col("sec"), rules.DIFF_SECURITY, place, "diff"),
                _finding_items(F.col("perf"), rules.DIFF_PERFORMANCE, place, "diff"),
            )
        ),
    )
    inserted = ["file_ord", "cat_rank", "rule_ord", "match_ord"]
    return _number_small(_ranked(items), inserted, ["sev_rank", *inserted])


def reviews_code(submissions: DataFrame) -> DataFrame:
    """Queue of each code submission (with ``filename``), sorted inside its row: no shuffle."""
    path = F.col("path")
    scanned = submissions.select(
        "analysis_id",
        paste_path().alias("path"),
        findings_array("code", rules.CODE_SECURITY).alias("sec"),
        findings_array("code", rules.CODE_PERFORMANCE).alias("perf"),
        complexity_of_code(F.col("code")).alias("complexity"),
    )
    title = F.concat(F.lit("High complexity ("), F.col("complexity"), F.lit(")"))
    items = scanned.select(
        "analysis_id",
        "path",
        F.concat(
            _finding_items(F.col("sec"), rules.CODE_SECURITY, path, "code"),
            _finding_items(F.col("perf"), rules.CODE_PERFORMANCE, path, "code"),
            _complexity_items(F.col("complexity"), title),
        ).alias("items"),
    )

    def with_keys(item: Column, i: Column) -> Column:
        return F.struct(
            rank_of(item["severity"], LEVEL_RANK).alias("sev_rank"),
            rank_of(item["category"], CATEGORY_RANK).alias("cat_rank"),
            (i + 1).alias("number"),
            item.alias("item"),
        )

    queue = F.array_sort(F.transform("items", with_keys))
    return items.select("analysis_id", "path", F.posexplode(queue).alias("pos", "entry")).select(
        "analysis_id",
        F.concat(F.lit("r"), "entry.number").alias("id"),
        (F.col("pos") + 1).cast("int").alias("priority"),
        "path",
        "entry.item.*",
    ).select(*OUTPUT)


def queue_counts(reviews: DataFrame) -> DataFrame:
    """Items, and critical, high and quick ones, per queue."""
    return reviews.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("severity") == "high").alias("n_high"),
        F.count_if(F.col("effort") == "quick").alias("n_quick"),
    )


def queue_counts_diff(sums: DataFrame) -> DataFrame:
    """The same counts for diffs, from their finding counts: no queue is built."""
    c = F.col
    n_sec = c("sec_critical") + c("sec_high") + c("sec_medium") + c("sec_low")
    n_perf = c("perf_high") + c("perf_medium") + c("perf_low")
    return sums.select(
        "analysis_id",
        (n_sec + n_perf).alias("n_items"),
        c("sec_critical").alias("n_critical"),
        (c("sec_high") + c("perf_high")).alias("n_high"),
        (c("sec_critical") + c("perf_medium") + c("perf_low")).alias("n_quick"),
    )


def queue_counts_pr(sums: DataFrame, coupled: DataFrame) -> DataFrame:
    """The same counts for pull requests; ``coupled`` has one row per coupled file."""
    c = F.col
    of_graph = coupled.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("n_coupled"),
        F.count_if(c("severity") == "high").alias("n_coupled_high"),
    )
    of_files = queue_counts_diff(sums).join(
        sums.select("analysis_id", "n_complex", "n_very_complex"), "analysis_id"
    )
    df = of_files.join(of_graph, "analysis_id", "left").fillna(0)
    return df.select(
        "analysis_id",
        (c("n_items") + c("n_complex") + c("n_coupled")).alias("n_items"),
        "n_critical",
        (c("n_high") + c("n_very_complex") + c("n_coupled_high")).alias("n_high"),
        "n_quick",
    )


def risk_heatmap(metrics: DataFrame) -> DataFrame:
    """Files by falling risk, in file order within a risk, with their position."""
    ranked = metrics.select(
        "analysis_id",
        "file_ord",
        "path",
        "risk",
        "complexity",
        rank_of(F.col("risk"), LEVEL_RANK).alias("risk_rank"),
    )
    placed = positions_in_group(
        reuse(ranked), ["analysis_id"], ["file_ord"], ["file_ord"], {"position": ["risk_rank"]}
    )
    return placed.drop("risk_rank", "file_ord")
