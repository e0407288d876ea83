"""Queues, scores and texts of small submissions worked out by hand."""

import pytest

from reviewloom.operators import diffs, graph, metrics, narrative, reviews, rollups, scores
from reviewloom.plans import analyses

SNIPPET = 'let a = eval("1");\nconst token = "abcdef";\nfunction go(b) { return eval(b); }'


def code(spark, *texts):
    rows = [(f"c{i}", t, ["", None, "a/b.py"][i % 3]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "analysis_id string, code string, filename string")


def test_code(spark):
    subs = code(spark, SNIPPET, "", "console.log(1)\n\nvar x")
    rows = {r.analysis_id: r for r in analyses.results_code(subs).collect()}
    r = rows["c0"]
    assert (r.security, r.overall, r.maintainability, r.total_additions) == (25, 55, 80, 3)
    assert r.summary == "TXT, 3 lines with text; 3 security and 0 performance findings; complexity 20 of 100."
    assert (rows["c1"].overall, rows["c1"].security, rows["c1"].complexity) == (100, 100, 90)
    assert (rows["c2"].overall, rows["c2"].total_additions) == (90, 2) and rows["c2"].summary.startswith("Python, 2 lines")
    queue = reviews.reviews_code(subs).filter("analysis_id = 'c0'").orderBy("priority").collect()
    assert [(q.id, q.severity, q.line, q.effort) for q in queue] == [
        ("r1", "critical", 1, "quick"), ("r2", "critical", 3, "quick"), ("r3", "critical", 2, "quick")]
    assert queue[0].title.startswith("Code Injection — ") and queue[0].path == "pasted-code"
    assert {q.path for q in reviews.reviews_code(subs).filter("analysis_id = 'c2'").collect()} == {"a/b.py"}
    files = {f.analysis_id: f for f in metrics.paste_files(subs).collect()}
    f = files["c2"]
    assert (f.path, f.status, f.additions, f.deletions, f.language) == ("a/b.py", "added", 2, 0, "Python")
    assert (f.old_start, f.old_lines, f.new_start, f.new_lines, f.content) == (1, 0, 1, 2, "console.log(1)\n\nvar x")
    assert (files["c1"].path, files["c1"].language, files["c1"].new_lines) == ("pasted-code", "TXT", 0)


def test_code_is_measured_without_a_shuffle(spark):
    plan = analyses.results_code(code(spark, SNIPPET))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_code_queue_orders_by_level_then_kind(spark):
    text = "console.log(1)\nMath.random()\nrows.forEach(async r => r)\neval(x)\nwhile (true) {}\n" + "if (a) {" * 25
    queue = reviews.reviews_code(code(spark, text)).orderBy("priority").collect()
    assert [(q.category, q.severity, q.effort) for q in queue] == [
        ("security", "critical", "quick"), ("performance", "high", "quick"), ("complexity", "high", "significant"),
        ("security", "medium", "moderate"), ("performance", "medium", "moderate"), ("performance", "low", "moderate")]
    assert [q.id for q in queue] == ["r1", "r3", "r6", "r2", "r5", "r4"]
    assert queue[2].title == "High complexity (100)" and queue[2].line is None


DIFF = (
    "diff --git a/src/x.ts b/src/x.ts\n@@ -1,2 +1,3 @@\n-eval(a)\n+rows.map(async r => r)\n+JSON.parse(JSON.stringify(a))\n"
    "diff --git a/y.py b/y.py\n@@ -1 +1 @@\n+box.innerHTML = a\n"
)


def test_diff(spark):
    df = spark.createDataFrame([("d", DIFF), ("none", "diff --git nothing")], "analysis_id string, diff string")
    rows = {r.analysis_id: r for r in analyses.results_diff(df).collect()}
    r = rows["d"]
    assert (r.security, r.complexity, r.maintainability, r.overall) == (70, 100, 85, 85)
    assert r.summary == "2 files in the diff, +3 -1. Critical: 1. High: 2. "
    assert (rows["none"].files_changed, rows["none"].overall) == (0, 94)
    assert rows["none"].summary == "0 files in the diff, +0 -0. Nothing urgent. "
    queue = reviews.reviews_diff(diffs.diff_files(diffs.file_blocks(df))).orderBy("priority").collect()
    assert [(q.id, q.category, q.severity, q.line, q.effort, q.title) for q in queue] == [
        ("r1", "security", "critical", 2, "quick", "Code Injection in x.ts"),
        ("r2", "performance", "high", 3, "moderate", "N+1 Pattern in x.ts"),
        ("r4", "security", "high", 2, "moderate", "XSS in y.py"),
        ("r3", "performance", "medium", 4, "quick", "Deep Clone Inefficiency in x.ts"),
    ]


PR_SCHEMA = "analysis_id string, file_ord int, path string, additions int, deletions int, patch string"


@pytest.fixture(scope="module")
def pr_files(spark):
    maze = "{" * 20
    return spark.createDataFrame(
        [
            ("p", 0, "src/a.ts", 10, 5, "@@\n+atob(x)"),
            ("p", 1, "src/b.ts", 90, 20, "@@\n+eval(x)\n+new RegExp(a)"),
            ("p", 2, "src/c.ts", 1, 0, maze),
            ("p", 3, "d.md", 60, 0, None),
            ("q", 0, "e.md", 0, 0, ""),
        ],
        PR_SCHEMA,
    )


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("p", "src/a.ts", t, 0) for t in "xyzuv"], "analysis_id string, source string, target string, source_ord int")


def test_pr(spark, pr_files, edges):
    measured = metrics.pr_file_metrics(pr_files)
    assert {r.path: r.risk for r in measured.collect()} == {
        "src/a.ts": "medium", "src/b.ts": "critical", "src/c.ts": "high", "d.md": "medium", "e.md": "low"}
    sums, coupled = scores.file_sums(measured, "pr"), graph.coupling(edges)
    items = reviews.review_items_pr(pr_files, coupled)
    queue = reviews.reviews_pr(items).orderBy("priority").collect()
    assert [(q.id, q.category, q.severity, q.path, q.title) for q in queue] == [
        ("r2", "security", "critical", "src/b.ts", "Code Injection in b.ts"),
        ("r4", "complexity", "high", "src/c.ts", "Very complex: c.ts (measure 90)"),
        ("r5", "architecture", "high", "src/a.ts", "Imports much: a.ts (5 imports)"),
        ("r1", "security", "low", "src/a.ts", "Unsafe Deserialization in a.ts"),
        ("r3", "performance", "low", "src/b.ts", "Dynamic Regex in b.ts"),
    ]
    counts = {r.analysis_id: r for r in reviews.queue_counts_pr(sums, coupled).collect()}
    [direct] = reviews.queue_counts(items).collect()
    assert counts["p"] == direct
    scored = {r.analysis_id: r for r in scores.scores_pr(sums, coupled).collect()}
    p = scored["p"]
    # Complexity: (14 + 14 + 90 + 10) / 4 = 32, so 88; two significant items cost 12.
    assert (p.security, p.performance, p.complexity, p.maintainability) == (78, 97, 88, 73)
    assert p.overall == round(78 * 0.3 + 97 * 0.25 + 88 * 0.25 + 73 * 0.2)
    totals = rollups.churn_totals(pr_files)
    text = {r.analysis_id: r.summary for r in narrative.summary_pr(totals, reviews.queue_counts_pr(sums, coupled), measured).collect()}
    assert text["p"] == "4 changed files, +161 -25. Critical: 1. High: 2. Quick to fix: 2. Risky files: b.ts, c.ts. "
    assert text["q"] == "1 changed files, +0 -0. Nothing urgent. "
    estimate = {r.analysis_id: r for r in scores.review_estimate(sums, scores.scores_pr(sums, coupled), reviews.queue_counts_pr(sums, coupled)).collect()}
    # 186 lines: 13, one critical 25, two high 24, and 13 * 12% rounded up 2.
    assert (estimate["p"].minutes, estimate["p"].estimate) == (64, "1h 4m")
    assert (estimate["q"].minutes, estimate["q"].estimate) == (15, "15m")
    shown = [(r.path, r.position) for r in reviews.risk_heatmap(measured).filter("analysis_id = 'p'").orderBy("position").collect()]
    assert shown == [("src/b.ts", 1), ("src/c.ts", 2), ("src/a.ts", 3), ("d.md", 4)]


def test_pr_levels(spark, pr_files):
    sums = scores.file_sums(metrics.pr_file_metrics(pr_files), "pr")
    assert {r.analysis_id: r.threat_level for r in scores.threat_level(sums).collect()} == {"p": "Critical", "q": "Clean"}
    assert {r.analysis_id: r.impact_level for r in scores.impact_level(sums).collect()} == {"p": "Low", "q": "Optimal"}
    counted = {r.analysis_id: r for r in scores.severity_counts(metrics.pr_file_metrics(pr_files)).collect()}
    assert (counted["p"].sec_files, counted["p"].perf_files, counted["q"].sec_files) == (2, 1, 0)
    assert {r.analysis_id: r.shown for r in scores.average_complexity(sums).collect()} == {"p": 32, "q": 10}


def test_repo(spark):
    info = spark.createDataFrame(
        [("r", "lib", "o/lib", "d" * 130, 500), ("bare", "none", "o/none", None, 0)],
        "analysis_id string, name string, full_name string, description string, stargazers_count long")
    languages = rollups.language_stats(spark.createDataFrame(
        [("r", 0, "Go", 75), ("r", 1, "C", 25)], "analysis_id string, lang_ord int, language string, bytes long"))
    files = spark.createDataFrame([("r", i, f"f{i}.go") for i in range(20)], "analysis_id string, file_ord int, path string")
    contents = spark.createDataFrame(
        [("r", 3, -9, "f3.go", "eval(x)\ninnerHTML ="), ("r", 4, -5, "f4.go", "{" * 18)],
        "analysis_id string, file_ord int, smaller long, path string, content string")
    parts = analyses.repo_parts(info, languages, files, contents)
    scored = {r.analysis_id: r for r in parts["scores"].collect()}
    # 14 and 82 for the files: average 48; architecture 80 - 20 * 0.15.
    assert (scored["r"].security, scored["r"].complexity, scored["r"].maintainability, scored["r"].architecture) == (70, 72, 85, 77)
    assert (scored["bare"].security, scored["bare"].complexity, scored["bare"].architecture, scored["bare"].overall) == (100, 100, 80, 92)
    text = {r.analysis_id: r.summary for r in narrative.summary_repo(parts["facts"]).collect()}
    assert text["r"].startswith(f'lib, mainly Go: {"d" * 130}. 20 files, 2 languages. Security: 1 critical. ')
    cut = {r.analysis_id: r.summary for r in narrative.summary_repo(parts["facts"], 10).collect()}
    assert cut["r"].startswith("lib, mainly Go: dddddddddd. 20 files")
    assert text["bare"] == (
        "none, mainly Unknown. 0 files, 0 languages. Security: nothing critical. "
        "Complexity: 20 on average. Score 92 of 100.")
    points = {}
    for r in narrative.insights_repo(parts["facts"]).orderBy("item_ord").collect():
        points.setdefault((r.analysis_id, r.section), []).append(r.text)
    assert points["r", "Weaknesses"] == [
        "1 critical security findings.", "1 high security findings.", "1 files are very complex."]
    assert points["r", "Strengths"][-1] == "Starred 500 times."
    assert points["bare", "Technical Debt"] == ["None to speak of."]
    queue = reviews.reviews_repo(contents).orderBy("priority").collect()
    assert [(q.id, q.title) for q in queue] == [
        ("r1", "Code Injection in f3.go"), ("r2", "XSS in f3.go"), ("r3", "Very complex: f4.go (82)")]
