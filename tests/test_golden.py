"""Values that must not change, written out here and not taken from the package."""

import pytest

from reviewloom.functions import rules
from reviewloom.operators import scan
from reviewloom.plans import analyses

# Every rule with its level and type.
RULES = """
PS01 critical Code Injection
PS02 critical Code Injection
PS03 high XSS
PS04 high XSS
PS05 medium XSS
PS06 critical SQL Injection
PS07 critical Hardcoded Secret
PS08 high Credential Leak
PS09 high Command Injection
PS10 medium Weak Randomness
PS11 medium Prototype Pollution Risk
PS12 low Unsafe Deserialization
PP01 high Waterfall Requests
PP02 high N+1 Pattern
PP03 medium Deep Clone Inefficiency
PP04 high DOM Thrashing
PP05 medium High-Frequency Timer
PP06 low Dynamic Regex
PP07 medium Silent Error Swallowing
PP08 medium Uncontrolled Fetch
RS01 critical Code Injection
RS02 critical Code Injection
RS03 high XSS
RS04 high XSS
RS05 critical SQL Injection
RS06 critical Hardcoded Secret
RS07 high Command Injection
RS08 medium Weak Randomness
CS01 critical Code Injection
CS02 critical Code Injection
CS03 high XSS
CS04 high XSS
CS05 critical SQL Injection
CS06 critical Hardcoded Secret
CS07 high Command Injection
CS08 medium Weak Randomness
CS09 medium DOM Manipulation
CS10 high Code Injection
CS11 critical Code Injection
CS12 high Dynamic Import
CS13 critical Unsafe Deserialization
CS14 high Command Injection
CS15 high Command Injection
CS16 high Unsafe YAML
CS17 critical SQL Injection
CS18 critical Command Injection
CS19 critical Unsafe Deserialization
CS20 high XXE
CS21 high Command Injection
CS22 high XSS
CS23 medium Unsafe Block
CS24 high Destructive SQL
CP01 high Async Anti-pattern
CP02 medium Dynamic Regex
CP03 medium Slow Deep Clone
CP04 low Console Statement
CP05 low Var Usage
CP06 low Non-Pythonic Loop
CP07 medium String Concatenation
CP08 low Wildcard Import
CP09 low StringBuffer Usage
CP10 low String Comparison
CP11 medium Infinite Loop Risk
CP12 medium Swallowed Error
DS01 critical Code Injection
DS02 high XSS
DS03 high XSS
DS04 critical SQL Injection
DS05 critical Hardcoded Secret
DS06 high Command Injection
DP01 high Waterfall Requests
DP02 high N+1 Pattern
DP03 medium Deep Clone Inefficiency
DP04 medium High-Frequency Timer
DP05 medium Silent Error Swallowing
"""

CASES = [
    # Complexity is 10, 3 for each control word, 4 for each level of brackets.
    # code, complexity, security, overall, maintainability, lines with text, findings (rule, line)
    ("eval(a)\n\nlet token = 'abc'\n", 14, 50, 70, 86, 2, {("CS01", 1), ("CS06", 3)}),
    ("var a = 1\n", 10, 100, 95, 90, 1, {("CP05", 1)}),
    ("if (a) { b() }\nos.system('x')\npickle.load(f)", 21, 65, 70, 79, 3, {("CS14", 2), ("CS13", 3)}),
    ("rows.forEach(async r => {\n  console.log(r)\n})", 22, 100, 90, 78, 3, {("CP01", 1), ("CP04", 2)}),
    ("", 10, 100, 100, 90, 0, set()),
]


def test_the_catalogue():
    found = [f"{r.rule_id} {r.level} {r.type}" for pack in rules.ALL_PACKS for r in pack]
    assert found == RULES.strip().split("\n") and len(found) == 75


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_results_worked_out_by_hand(spark, case):
    code, complexity, security, overall, maintainability, lines, findings = case
    df = spark.createDataFrame([("x", code, None)], "analysis_id string, code string, filename string")
    [row] = analyses.results_code(df).collect()
    assert (row.security, row.overall, row.maintainability, row.total_additions) == (security, overall, maintainability, lines)
    assert row.summary.endswith(f"complexity {complexity} of 100.")
    packs = (rules.CODE_SECURITY, rules.CODE_PERFORMANCE)
    found = {(r.rule_id, r.line) for pack in packs for r in scan.scan(df.select("analysis_id", "code"), pack, "code").collect()}
    assert found == findings
