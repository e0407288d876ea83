"""Scans by catalogues of one's own, of thousands of rules.

``scan.scan`` unrolls its rules, so a text is tested for each. Here the strings that each rule requires are taken out
of its pattern (``required``), and one Aho-Corasick pass over a text names the rules whose strings are in it. Only
those patterns, and the few that require nothing, are run on the text.
"""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.required import required
from reviewloom.functions.rules import Rule
from reviewloom.operators import scan
from reviewloom.session import shipped

#: A catalogue of up to so many characters is sent to every executor, a larger one is joined by a shuffle.
SMALL = 8 << 20


def folded(text: str) -> str:
    """The UTF-8 bytes, a character each, with ASCII letters in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("latin-1")


@cache
def _automaton(gates: tuple[tuple[str, tuple[int, ...]], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for text, orders in gates:
        found.add_word(text, orders)
    found.make_automaton()
    return found


def candidates(text: Column, gated: dict[int, frozenset[str] | None]) -> Column:
    """The ``rule_ord``s of the rules that can match in a text, ascending; null texts have none."""
    by_text: dict[str, set[int]] = {}
    for order, strings in gated.items():
        for string in strings or ():
            by_text.setdefault(folded(string), set()).add(order)
    gates = tuple((t, tuple(sorted(o))) for t, o in sorted(by_text.items()))
    always = sorted(o for o, strings in gated.items() if not strings)

    @F.pandas_udf("array<int>")
    def named(texts: pd.Series) -> pd.Series:
        automaton = _automaton(gates) if gates else None

        def one(text: str | None) -> list[int]:
            if text is None:
                return []
            hits = {orders for _, orders in automaton.iter(folded(text))} if automaton else ()
            return sorted({o for orders in hits for o in orders}.union(always))

        return texts.map(one, na_action=None)

    return named(text)


def scan_catalogue(files: DataFrame, pack: list[Rule], text: str = "content") -> DataFrame:
    """What ``scan.scan`` gives for ``pack``: one row per match of any rule, with the other columns of ``files``.

    Rules need different ``rule_ord``s. Those with a linear form of their own (the built-in slow ones) are unrolled.
    """
    if len({r.rule_ord for r in pack}) != len(pack):
        raise ValueError("rules share a rule_ord")
    shipped(files.sparkSession)
    own = [r for r in pack if r.pattern.linear or r.pattern.cut]
    rest = [r for r in pack if not (r.pattern.linear or r.pattern.cut)]
    unrolled = scan.scan(files, own, text) if own or not rest else None
    if not rest:
        return unrolled
    schema = "rule_id string, kind string, type string, level string, rule_ord int, java string"
    rows = [(r.rule_id, r.kind, r.type, r.level, r.rule_ord, r.java) for r in rest]
    rules = files.sparkSession.createDataFrame(rows, schema).select(F.struct("*").alias("__rule"))
    small = sum(len(x) for row in rows for x in row if isinstance(x, str)) <= SMALL
    gates = {r.rule_ord: required(r.pattern.regex) for r in rest}
    keys = [c for c in files.columns if c != text]
    some = files.withColumn("__orders", candidates(F.col(text), gates)).withColumn("__order", F.explode("__orders")).drop("__orders")
    met = some.join(F.broadcast(rules) if small else rules, F.col("__order") == F.col("__rule.rule_ord"))
    # The same expressions as in an unrolled scan, with the rule's parts as columns.
    lines = scan.lines(f"`{text}`", "__rule.java")
    finding = (
        "named_struct('rule_id', __rule.rule_id, 'kind', __rule.kind, 'type', __rule.type, 'level', __rule.level, "
        "'line', CAST(line AS INT), 'rule_ord', __rule.rule_ord, 'match_ord', CAST(i + 1 AS INT))"
    )
    array = F.expr(
        f"CASE WHEN rlike(`{text}`, __rule.java) THEN transform({lines}, (line, i) -> {finding}) ELSE {scan.NO_FINDINGS} END"
    )
    gated = met.select(*keys, F.inline(array))
    return gated if unrolled is None else unrolled.unionByName(gated)
