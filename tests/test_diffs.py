"""Diffs taken apart."""

from reviewloom.operators import diffs


def blocks(spark, *texts):
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "analysis_id string, diff string")
    return diffs.file_blocks(df)


HEAD = "diff --git a/x.py b/x.py\n"


def hunks(spark, body):
    rows = diffs.diff_hunks(blocks(spark, HEAD + body)).orderBy("hunk_ord").collect()
    return [(r.old_start, r.old_lines, r.new_start, r.new_lines, r.content) for r in rows]


def test_files_and_counts(spark):
    diff = (
        "junk\ndiff --git a/old.ts b/dir/new.ts\n--- a/old.ts\n+++ b/dir/new.ts\n@@ -1,2 +1,3 @@\n-gone\n+new\n+\n++plus\n ctx\n"
        "diff --git nothing here\n@@ -1 +1 @@\n+x\n"
        "diff --git a/k b/k\n@@ -1 +0,0 @@\n-only\n"
        "diff --git a/n.go b/n.go\nBinary\n+"
    )
    rows = diffs.diff_files(blocks(spark, diff)).orderBy("file_ord").collect()
    assert [(r.file_ord, r.path, r.status, r.additions, r.deletions, r.language) for r in rows] == [
        (0, "dir/new.ts", "modified", 2, 1, "TypeScript"),
        (1, "k", "deleted", 0, 1, "K"),
        (2, "n.go", "modified", 0, 0, "Go"),
    ]
    assert rows[2].code == ""


def test_hunks(spark):
    body = "@@ -1,2 +3,4 @@ def f():\n a\n+b\n@@ -9 +12 @@\n c\n"
    assert hunks(spark, body) == [(1, 2, 3, 4, "\n a\n+b"), (9, None, 12, None, "\n c\n")]


def test_body_ends_at_any_line_of_ats(spark):
    assert hunks(spark, "@@ -1,1 +1,1 @@\n a\n@@ no header\n b\n@@ -5,, +6,7,8 @@ t\n c") == [
        (1, 1, 1, 1, "\n a"), (5, 0, 6, 7, "\n c")]


def test_header_inside_a_line_belongs_to_both(spark):
    got = hunks(spark, "@@ -1,1 +1,1 @@\n a @@ -2,2 +2,2 @@ tail\n b\n@@ -3,3 +3,3 @@\n c")
    assert got == [
        (1, 1, 1, 1, "\n a @@ -2,2 +2,2 @@ tail\n b"),
        (2, 2, 2, 2, "\n b"),
        (3, 3, 3, 3, "\n c"),
    ]


def test_no_hunk_and_no_number(spark):
    assert hunks(spark, "index 1..2\n") == []
    assert hunks(spark, "@@ -, +1 @@\nx") == [(0, 0, 1, None, "\nx")]


def test_carriage_returns_end_lines(spark):
    rows = diffs.diff_files(blocks(spark, "diff --git a/x.py b/x.py\r\n@@ -1 +1 @@\r\n+a\r\n-b\r\n")).collect()
    assert [(r.path, r.additions, r.deletions) for r in rows] == [("x.py", 1, 1)]


def test_no_shuffle(spark):
    plan = diffs.diff_files(blocks(spark, HEAD + "@@ -1 +1 @@\n+a"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
