"""Rule scans against Python's own matcher, on texts put together at random."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import rules
from reviewloom.functions.binding import quoted
from reviewloom.operators.scan import flatten, findings_array, level_counts, scan
from reviewloom.plans.bank import SNIPPETS

PIECES = [
    "eval", "evaluate", "new ", "Function", "(", ")", "()", "{", "}", "innerHTML", "=", "dangerouslySetInnerHTML",
    "document.write", "document", "DOM", "${", "query", "execute", "exec", "password", "SECRET", "api_key", "token",
    ":", "'", '"', "`", "abc", "console.log", "console.warn", "spawn", "execSync", "Math.random", "Object.assign",
    "...", "atob", "await ", ".then(", ".map", "async", "JSON.parse", "JSON.stringify", "for", "while", "setInterval",
    ",", "50", "5", "500", "RegExp", "try", "catch", "e", "useEffect", "=>", "fetch", "window.location", "__import__",
    "pickle.load", "s", "os.system", "subprocess.call", "yaml.load", "Loader", "SQL", "+", "f", "unsafe", "DELETE",
    "drop", "FROM", ".forEach", "var ", "in", "range", "len", "import", "*", "StringBuffer", ".equals", "true",
    " ", "  ", "\n", "\n\n", "\t", "x", "_", "1",
]


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    # Whole snippets, joined and cut anywhere, give the rarer rules their chance.
    bodies = [b for _, b in SNIPPETS if b.isascii()]
    for _ in range(n):
        joined = "\n".join(rng.sample(bodies, 3))
        made.append(joined[rng.randint(0, 20):])
    return made + ["", "\n", "eval(", "\neval(\neval("]


def expected(text: str, pack) -> list[tuple]:
    found = []
    for rule in pack:
        flags = re.ASCII | (re.IGNORECASE if rule.pattern.ignore_case else 0)
        for i, m in enumerate(re.finditer(rule.pattern.regex, text, flags), start=1):
            found.append((rule.rule_id, text.count("\n", 0, m.start()) + 1, i))
    return found


@pytest.mark.parametrize("pack", rules.ALL_PACKS, ids=lambda p: p[0].rule_id[:2])
def test_scan_finds_what_python_finds(spark, pack):
    made = texts(7, 150)
    df = spark.createDataFrame(list(enumerate(made)), "id int, content string")
    rows = scan(df, pack).collect()
    got = sorted((r.id, r.rule_id, r.line, r.match_ord) for r in rows)
    want = sorted((i, *f) for i, t in enumerate(made) for f in expected(t, pack))
    assert got == want
    assert len(want) > 50


SLOW = {
    "template_sql": ["${", "}", "query", "exec", "execute (", "(", " ", "\n", "x", "{", "$"],
    "dom_loop": ["for", "while", "for(", "while (", "(", "{", "}", "document", "DOM", "innerHTML", "a", " ", "\n", "_", ";", "\t"],
    "fast_timer": ["setInterval", "setInterval(", "(", ",", "5", "50", "500", ")", " ", "\n", "a", ", 9)"],
    "new_regexp_args": ["new RegExp(", "new", " ", "RegExp", "(", ")", "a", "\n"],
    "yaml_load": ["yaml.load", "yaml.load(", "(", "Loader", " ", "\n", "a", "Loader("],
    "empty_catch_try": ["try", "try {", "{", "}", "catch", "catch (e) {", "(", ")", "e", " ", "\n", "} catch (e) { }"],
    "effect_fetch": ["useEffect", "useState(", "(() => {", "()", "=>", "{", "(", "fetch", " ", "\n", "a"],
}


@pytest.mark.parametrize("name", sorted(SLOW))
def test_linear_forms_find_the_same(spark, name):
    rng = random.Random(name)
    made = ["".join(rng.choice(SLOW[name]) for _ in range(rng.randint(1, 45))) for _ in range(3000)]
    pattern = rules.PATTERNS[name]
    rule = rules.Rule("X01", 1, "security", "t", "high", pattern, "n", "a")
    df = spark.createDataFrame(list(enumerate(made)), "id int, content string").repartition(8)
    got = sorted((r.id, r.rule_id, r.line, r.match_ord) for r in scan(df, [rule]).collect())
    want = sorted((i, *f) for i, t in enumerate(made) for f in expected(t, [rule]))
    assert got == want and len(want) > 50


@pytest.mark.parametrize("name", sorted(rules.PATTERNS))
def test_long_lines_take_no_longer_than_their_length(spark, name):
    """A line of 100 kB made of what a match begins with, and then of what it is made of."""
    pattern = rules.PATTERNS[name]
    rule = rules.Rule("X01", 1, "security", "t", "high", pattern, "n", "a")
    pieces = SLOW.get(name, [*pattern.needs, "password='", "console.log(", "DELETE ", "await "])
    lines = [(p * (100_000 // len(p) + 1))[:100_000] + "".join(pattern.needs) for p in pieces if p.strip()]
    compiled = spark._jvm.java.util.regex.Pattern.compile(rule.java)
    for line in lines:
        text = spark.createDataFrame([(line,)], "t string").selectExpr(rule.text("t")).first()[0]
        start = time.perf_counter()
        compiled.matcher(text).results().count()
        assert time.perf_counter() - start < 1.5, line[:40]


def test_every_rule_is_hit_and_missed_by_the_bank():
    for pack in rules.ALL_PACKS:
        for rule in pack:
            flags = re.IGNORECASE if rule.pattern.ignore_case else 0
            hits = [bool(re.search(rule.pattern.regex, body, flags)) for _, body in SNIPPETS]
            assert any(hits), rule.rule_id
            assert not all(hits), rule.rule_id


def test_gates_hold_for_every_match():
    for text in texts(11, 200):
        for pack in rules.ALL_PACKS:
            for rule in pack:
                flags = re.ASCII | (re.IGNORECASE if rule.pattern.ignore_case else 0)
                for m in re.finditer(rule.pattern.regex, text, flags):
                    if rule.pattern.needs:
                        assert any(n in m.group() for n in rule.pattern.needs), rule.rule_id
                    if rule.pattern.starts:
                        assert m.group()[0].lower() in rule.pattern.starts, rule.rule_id


def test_counts_agree_with_findings(spark):
    made = texts(3, 60)
    df = spark.createDataFrame(list(enumerate(made)), "id int, content string")
    counted = df.select("id", *level_counts("content", rules.CODE_SECURITY, "sec")).collect()
    for row in counted:
        by_level = {lv: 0 for lv in ("critical", "high", "medium", "low")}
        level_of = {r.rule_id: r.level for r in rules.CODE_SECURITY}
        for rule_id, _, _ in expected(made[row.id], rules.CODE_SECURITY):
            by_level[level_of[rule_id]] += 1
        assert {lv: row[f"sec_{lv}"] for lv in by_level} == by_level


def test_wide_spaces_count_as_space_and_marks_in_text_do_no_harm(spark):
    df = spark.createDataFrame(
        [(1, "eval (x) eval﻿("), (2, "\neval()\neval("), (3, "eval(")],
        "id int, content string",
    )
    rows = sorted((r.id, r.line) for r in scan(df, rules.PR_SECURITY).collect())
    assert rows == [(1, 1), (1, 1), (2, 2), (2, 3)]


def test_flatten_keeps_the_file(spark):
    df = spark.createDataFrame([("a.js", "eval(1)\nexec('x')")], "path string, content string")
    nested = df.select("path", findings_array("content", rules.PR_SECURITY).alias("issues"))
    rows = [(r.path, r.rule_id, r.line) for r in flatten(nested, "issues").collect()]
    assert rows == [("a.js", "PS01", 1), ("a.js", "PS09", 2)]
    empty = nested.withColumn("issues", F.lit(None).cast(nested.schema["issues"].dataType))
    assert flatten(empty, "issues").count() == 0


def test_catalogue_goes_to_a_table_and_back(spark):
    table = rules.catalogue(spark)
    assert table.count() == 75
    back = rules.from_table(table.filter("rule_id like 'CS%'"))
    assert [r.pattern for r in back] == [r.pattern for r in rules.CODE_SECURITY]
    broken = table.limit(1).withColumn("regex", F.lit("(a"))
    with pytest.raises(ValueError, match="has no valid regex"):
        rules.from_table(broken)
    df = spark.createDataFrame([(1, SNIPPETS[0][1])], "id int, content string")
    assert scan(df, back).collect() == scan(df, rules.CODE_SECURITY).collect()


def test_literals_survive_the_parser(spark):
    odd = ["a'b", "back\\slash\\n", "${name} $1 ${a}", "line\nbreak\ttab", '"`é', "\\u0041", "%_\\%"]
    columns = [F.expr(quoted(v)).alias(f"c{i}") for i, v in enumerate(odd)]
    assert list(spark.range(1).select(*columns).first()) == odd
