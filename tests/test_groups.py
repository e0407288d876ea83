"""Positions, parts and joins where one group holds most rows."""

import random

from reviewloom.operators import joins, narrative, ranking
from reviewloom.plans import analyses


def test_positions_agree_with_a_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 3)
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.randint(0, 3), -rng.randint(0, 4), rng.randint(0, 60), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, c int, s int, o int, i int")
    for along in (["o"], ["s", "o"]):
        order = [*along, "i"]
        got = ranking.positions_in_group(df, ["g"], along, order, {"by_c": ["c"], "plain": []}).collect()
        assert len(got) == len(rows)
        keyed = [dict(zip("gcsoi", r)) for r in rows]
        for group in {r["g"] for r in keyed}:
            mine = [r for r in keyed if r["g"] == group]
            plain = {r["i"]: k for k, r in enumerate(sorted(mine, key=lambda r: [r[x] for x in order]), start=1)}
            by_c = {r["i"]: k for k, r in enumerate(sorted(mine, key=lambda r: [r[x] for x in ["c", *order]]), start=1)}
            for r in got:
                if r.g == group:
                    assert (r.by_c, r.plain) == (by_c[r.i], plain[r.i])


def test_lists_are_whole_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 4)
    rng = random.Random(2)
    rows = [("a", rng.randint(0, 2), rng.randint(0, 90), i, f"e{i}") for i in range(300)] + [("c", 0, 0, 0, "x")]
    entries = spark.createDataFrame(rows, "analysis_id string, lead int, o int, i int, entry string")
    got = narrative.listed(entries, ["o"], ["o", "i"], ", ", ("lead",)).collect()
    want = [r[4] for r in sorted(r for r in rows if r[0] == "a")]
    assert {r.analysis_id: (r.listed, r.n_listed) for r in got} == {"a": (", ".join(want), 300), "c": ("x", 1)}


def test_a_request_with_many_risky_files_lists_all_of_them(spark):
    files = spark.createDataFrame(
        [("p", i, f"src/f{i}.js", 300, 0, "@@") for i in range(700)],
        "analysis_id string, file_ord int, path string, additions int, deletions int, patch string")
    none = spark.createDataFrame([], "analysis_id string, path string, file_ord int, content string")
    [row] = analyses.results_pr(files, none).collect()
    assert row.summary == "700 changed files, +210000 -0. Risky files: " + ", ".join(f"f{i}.js" for i in range(700)) + ". Nothing urgent. "


def test_queries_build_without_a_job(spark, sf_dir):
    from reviewloom.plans.registry import REGISTRY

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    for name, query in REGISTRY.items():
        if not name.startswith("stream_"):
            query(spark, sf_dir)
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("build")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Reading a table's schema is a job of one task per table; nothing else runs.
    assert all(len(j.stageIds) == 1 for j in jobs)
    assert len(jobs) <= 3 * len(REGISTRY)


def test_salted_join_is_an_inner_join(spark):
    few = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k int, v string")
    many = spark.createDataFrame([(1 if i % 2 else i % 5, i) for i in range(200)], "k int, i int")
    got = sorted(map(tuple, joins.salted_join(few, many, ["k"], "i").select("k", "v", "i").collect()))
    assert got == sorted(map(tuple, few.join(many, "k").select("k", "v", "i").collect()))
