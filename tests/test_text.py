"""Measures of texts and paths."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import lookup, text


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def single(spark, inputs, column):
    return [v[0] for v in values(spark, inputs, column)]


V = F.col("v")


def test_lines(spark):
    inputs = ["", "a", "a\n", "\n\n", " \n\t\nx \n \n ", "a\r\nb\r\n", "\n a"]
    assert single(spark, inputs, text.line_count(V)) == [1, 1, 2, 3, 5, 3, 2]
    assert single(spark, inputs, text.non_blank_lines(V)) == [0, 1, 1, 0, 1, 2, 1]
    assert single(spark, ["", " \n﻿", "x"], text.is_blank(V)) == [True, True, False]


def brute_complexity(t, control, arrows, opening, closing):
    words = len(re.findall(r"\b(?:" + "|".join(control) + r")\b", t, re.ASCII))
    functions = len(re.findall(r"\b(?:" + arrows + r")\b", t, re.ASCII))
    now = top = 0
    for ch in t:
        now += (ch in opening) - (ch in closing)
        top = max(top, now)
    return min(100, max(5, 10 + 3 * words + 2 * functions + 4 * top + (t.count("\n") + 1) // 20))


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    pieces = ["if", "else", "else if", "else  if", "do", "match", "fn", "pub fn", "func ", "=>", "x", "é", "_", " ",
              "\n", "{", "}", "(", ")", "[", "]", "def", "method", "function", "try", "catch", "main", "switch"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 80))) for _ in range(300)] + [
        "", ")))(", "\n" * 45, "x=>y => z", "{" * 40]


def test_complexity(spark, made):
    v1 = "function|=>|def|fn|func|method"
    got = values(spark, made, text.complexity_of_file(V), text.complexity_of_code(V))
    for t, (file, code) in zip(made, got):
        assert file == brute_complexity(t, text.CONTROL_WORDS, v1, "{(", "})")
        v2 = v1 + r"|pub\s+fn|fn\s+main|func\s+"
        assert code == brute_complexity(t, text.CONTROL_WORDS_CODE, v2, "{([", "})]")


def test_complexity_of_diff(spark, made):
    for t, got in zip(made, single(spark, made, text.complexity_of_diff(V))):
        words = len(re.findall(r"\b(?:if|else|for|while|switch|try|catch)\b", t, re.ASCII))
        functions = len(re.findall(r"\b(?:function|=>|def|fn)\b", t, re.ASCII))
        assert got == min(100, 10 + 3 * words + 2 * functions)


def test_paths(spark):
    paths = ["src/a/b.test.TS", "Dockerfile", "src/Makefile", "x.", "/root.py", ".env", "a/b/"]
    got = values(spark, paths, lookup.extension(V), lookup.language(V), lookup.basename(V), lookup.parent(V))
    assert got == [
        ("ts", "TypeScript", "b.test.TS", "src/a"),
        ("dockerfile", "Dockerfile", "Dockerfile", ""),
        ("src/makefile", "SRC/MAKEFILE", "Makefile", "src"),
        ("", "Unknown", "x.", ""),
        ("py", "Python", "root.py", ""),
        ("env", "ENV", ".env", ""),
        ("a/b/", "A/B/", "", "a/b"),
    ]
    assert single(spark, ["Go", "Klingon"], lookup.color(V)) == ["#00ADD8", "#6B7280"]


def test_language_by_content(spark):
    texts = ["x = 1\n  def f(): pass", "def f\nfunction g", "struct A {}", "package main", "public void x() {} ;  \nfoo",
             "public x\n;", "<?= 1", "#include <a>", "let x", "éimport os\n"]
    assert single(spark, texts, text.language_by_content(V)) == [
        "python", "javascript", "rust", "go", "java", "javascript", "php", "c", "javascript", "javascript"]


def test_imports(spark):
    source = (
        "import { a,\n b } from './one';\nimport * as c from \"two\";\nimport d from 'one/three'; import './side';\n"
        "const e = await import ( 'four' ), f = require('two'), g = require(x);\nfrom five.six import y\nimport os\n"
    )
    [(repo, pr)] = values(spark, [source], text.imports_of_repo_file(V), text.imports_of_pr_file(V))
    assert repo == ["./one", "two", "one/three", "four"]
    junk = [a or b for a, b in re.findall(r"(?:from\s+(\S+)\s+import|import\s+(\S+))", source)]
    assert "five.six" in junk and "{" in junk
    assert pr == list(dict.fromkeys(repo + junk))
    assert values(spark, [""], text.imports_of_repo_file(V)) == [([],)]


def test_bands_and_rounding(spark):
    assert single(spark, ["80", "79.5", "40", "39"], lookup.score_band(V.cast("double"))) == [
        "Excellent", "Good", "Needs Work", "Critical"]
    assert single(spark, ["81", "80", "60", "41", "40"], lookup.complexity_band(V.cast("int"))) == [
        "critical", "high", "medium", "medium", "low"]
    assert single(spark, ["2.5", "-2.5", "0.4999"], lookup.round_half_up(V.cast("double"))) == [3, -2, 0]


def test_looks_like_diff(spark):
    texts = ["diff --git a b\n@@ x", "x\n@@ y\ndiff --git q", " diff --git a\n@@ b", "diff --git a\n @@ b", "@@ a\rdiff --git b"]
    assert single(spark, texts, text.looks_like_diff(V)) == [True, True, False, False, False]


def test_line_ends_are_matched_by_ranges():
    # Single characters above U+00FF, united in a class, take Java ten times as long for each character.
    from reviewloom.functions.dialect import LINE_START, to_java

    for form in (to_java('a.*b'), LINE_START):
        assert r"\x{2028}-\x{2029}" in form and r"\x{2028}\x{2029}" not in form


def test_measures_on_random_text(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from reviewloom.functions import text as measures

    pieces = ["function", "func", "fn", "def", "method", "=>", "=", ">", "x", "_", "9", "é", "😀", " ", "\t", "\r", "\n", " ", "﻿", "a=>b"]
    rng = random.Random(5)
    texts = ["", "\n", " ", "=>", "fn", "x=>y"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    space = "[\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
    named = re.compile(r"(?<![A-Za-z0-9_])(?:function|def|fn|func|method)(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])=>(?=[A-Za-z0-9_])")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    count = F.regexp_count(t, F.lit(measures._function_words(measures.FUNCTION_WORDS)))
    for r in df.select("i", "t", count.alias("n"), measures.line_count(t).alias("lines"), measures.non_blank_lines(t).alias("full")).collect():
        assert r.n == len(named.findall(r.t)), repr(r.t)
        assert r.lines == r.t.count("\n") + 1
        assert r.full == sum(1 for line in r.t.split("\n") if re.sub(space, "", line)), repr(r.t)
