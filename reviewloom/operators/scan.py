"""Rule scans: where each rule matches, and how often.

Every rule is unrolled into the expression of one projection, with its pattern as a
literal, so a scan reads the text once, needs no shuffle and compiles each pattern once
per task.  A substring that every match must contain is checked first on the raw bytes;
most rules are settled there, without decoding the text.

The expressions are written as SQL: a pack is parsed in one go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.binding import quoted
from reviewloom.functions.rules import Rule

# Put before each match to find its line.  A private-use character matches no pattern
# token but the negated classes, as does the one that stands in for it if a text has it.
_MARK, _STAND_IN = "", ""

FINDING = "struct<rule_id:string,kind:string,type:string,level:string,line:int,rule_ord:int,match_ord:int>"
NO_FINDINGS = f"CAST(array() AS array<{FINDING}>)"

# Levels of the findings of each kind; the prefixes name count columns.
LEVELS = {
    "sec": ("critical", "high", "medium", "low"),
    "perf": ("high", "medium", "low"),
}


def _possible(text: str, rule: Rule) -> str:
    """A cheap test that is true wherever the rule can match."""
    tests = [f"contains({text}, {quoted(n)})" for n in rule.pattern.needs]
    return f"({' OR '.join(tests)})" if tests else "true"


def lines(text: str, regex: str, replacement: str = quoted(_MARK + "$0")) -> str:
    """Line of every match of ``regex`` (SQL expressions), in order of place; ``replacement`` puts a mark before each."""
    mark = quoted(_MARK)
    clean = f"IF(contains({text}, {mark}), translate({text}, {mark}, {quoted(_STAND_IN)}), {text})"
    marked = f"regexp_replace({clean}, {regex}, {replacement})"
    repeated = f"array_repeat(i + 1, length(l) - length(replace(l, {mark}, '')))"
    return f"flatten(transform(split({marked}, '\\n', -1), (l, i) -> {repeated}))"


def _match_lines(text: str, rule: Rule) -> str:
    before, after = rule.marked
    return lines(rule.text(text), quoted(rule.java), quoted(before + _MARK + after))


def _rule_findings(text: str, rule: Rule) -> str:
    finding = (
        f"named_struct('rule_id', {quoted(rule.rule_id)}, 'kind', {quoted(rule.kind)}, "
        f"'type', {quoted(rule.type)}, 'level', {quoted(rule.level)}, 'line', CAST(line AS INT), "
        f"'rule_ord', {rule.rule_ord}, 'match_ord', CAST(i + 1 AS INT))"
    )
    return (
        f"CASE WHEN {_possible(text, rule)} AND rlike({rule.text(text)}, {quoted(rule.java)}) "
        f"THEN transform({_match_lines(text, rule)}, (line, i) -> {finding}) ELSE {NO_FINDINGS} END"
    )


def findings_array(text: str, *packs: list[Rule]) -> Column:
    """All findings of the packs in one text (a SQL expression), rule by rule."""
    found = [_rule_findings(text, r) for pack in packs for r in pack]
    return F.expr(f"concat({', '.join(found or [NO_FINDINGS])})")


def level_counts(text: str, pack: list[Rule], prefix: str) -> list[Column]:
    """Findings of a pack by level, without their lines: ``<prefix>_<level>`` columns."""

    def count(rule: Rule) -> str:
        return (
            f"IF({_possible(text, rule)}, regexp_count({rule.text(text)}, {quoted(rule.java)}), 0)"
        )

    columns = []
    for level in LEVELS[prefix]:
        terms = [count(r) for r in pack if r.level == level]
        columns.append(F.expr(f"CAST({' + '.join(terms) or '0'} AS INT)").alias(f"{prefix}_{level}"))
    return columns


def levels_found(found: Column, prefix: str) -> list[Column]:
    """The same columns from findings that are there already (``findings_array`` of the pack)."""

    def count(level: str) -> Column:
        return F.size(F.filter(found, lambda f: f["level"] == level))

    return [count(level).alias(f"{prefix}_{level}") for level in LEVELS[prefix]]


def scan(files: DataFrame, pack: list[Rule], text: str = "content") -> DataFrame:
    """One row per match of any rule of ``pack``; the other columns of ``files`` are kept."""
    keys = [F.col(c) for c in files.columns if c != text]
    # Generating from the expression, not from a column of it, keeps the optimizer from
    # adding a filter on that column, which would work the scan out again.
    return files.select(*keys, F.inline(findings_array(text, pack)))


def flatten(files: DataFrame, nested: str) -> DataFrame:
    """Findings nested in a column of their file, in long form with the file's other columns."""
    keys = [F.col(c) for c in files.columns if c != nested]
    return files.select(*keys, F.inline(F.coalesce(nested, F.expr(NO_FINDINGS))))


def notes(pack: list[Rule]) -> Column:
    """What a finding of ``pack`` means, by its ``rule_ord``."""
    return F.get(F.array(*[F.lit(r.note) for r in pack]), F.col("rule_ord") - 1)
