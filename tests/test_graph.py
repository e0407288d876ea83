"""Edges against the nested loops they stand for."""

import random

import pytest

from reviewloom.operators import graph
from reviewloom.operators.joins import salted_join

SCHEMA = "analysis_id string, file_ord int, path string, content string"
NAMES = ["a", "b", "util", "index", "x.test", "util.min", "lib"]
EXTS = ["ts", "tsx", "js", "py", "d.ts"]


@pytest.fixture(scope="module")
def files():
    rng = random.Random(3)
    made = []
    for repo in ("r1", "r2", "r3"):
        paths = sorted({
            "/".join(rng.choice(["src", "lib", "a", "util"]) for _ in range(rng.randint(0, 3)))
            .lstrip("/") + "/" * rng.randint(0, 1) + f"{rng.choice(NAMES)}.{rng.choice(EXTS)}"
            for _ in range(40)
        })
        paths += ["top.ts", "./odd.ts", "src/.hidden", "Makefile"]
        for i, path in enumerate(paths):
            modules = [rng.choice(["a", "lib/util", "./a", "../util", "@/lib/util", "/src/a", "@scope/util", "x.test",
                                   "s", "ts", "odd", "./odd", "util/", "index", "src/a", "/", "@/", "b.ts", "lib"])
                       for _ in range(4)]
            code = "\n".join(f"import q from '{m}';" if k % 2 else f"require('{m}')" for k, m in enumerate(modules))
            made.append((repo, i, path, code))
    return made


def named(code, python):
    import re

    out = re.findall(r"import\s+\w+\s+from\s+'([^']+)'", code) + re.findall(r"require\('([^']+)'\)", code)
    if python:
        out += re.findall(r"import\s+(\S+)", code)
    return list(dict.fromkeys(out))


def test_pr_edges(spark, files):
    df = spark.createDataFrame(files, SCHEMA)
    got = sorted((r.analysis_id, r.source, r.target, r.type, r.imp_ord)
                 for r in graph.edges_pr(graph.imports_pr(df), df).collect())
    want = []
    for repo, _, source, code in files:
        for k, m in enumerate(named(code, True)):
            for other, _, target, _ in files:
                if other == repo and target != source and any(target.endswith(m + t) for t in graph.PR_TAILS):
                    want.append((repo, source, target, "import" if m.startswith(".") else "require", k))
    assert got == sorted(want)
    assert len(want) > 100


def test_pr_edges_resolved(spark, files):
    import posixpath

    df = spark.createDataFrame(files, SCHEMA)
    got = sorted((r.analysis_id, r.source, r.target, r.imp_ord)
                 for r in graph.edges_pr(graph.imports_pr(df), df, resolve_dots=True).collect() if r.type == "import")
    want = []
    for repo, _, source, code in files:
        for k, m in enumerate(named(code, True)):
            path = posixpath.normpath(posixpath.join(posixpath.dirname(source.lstrip("/")), m))
            want += [(repo, source, target, k) for other, _, target, _ in files
                     if m.startswith(".") and other == repo and target != source and target in {path + t for t in graph.PR_TAILS}]
    assert got == sorted(want) and len(want) > 5
    plain = [r for r in graph.edges_pr(graph.imports_pr(df), df).collect() if r.type == "require"]
    kept = [r for r in graph.edges_pr(graph.imports_pr(df), df, resolve_dots=True).collect() if r.type == "require"]
    assert sorted(plain) == sorted(kept)


def test_dots(spark):
    paths = {"a/./b//c": "a/b/c", "a/../b": "b", "../x": "../x", "../../x": "../../x", "a/../../x": "../x", ".": "", "a/b/..": "a", "./": ""}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.q for r in df.select("p", graph._collapse_dots(df.p).alias("q")).collect()} == paths


def fits(source, m, target):
    if m.startswith("."):
        folder = source.rpartition("/")[0]
        path = (folder + "/" if folder else "") + m
        while "//" in path:
            path = path.replace("//", "/")
        return target in [path + t for t in graph.RELATIVE_TAILS]
    if m.startswith(("@/", "/")):
        rest = m[2:] if m.startswith("@/") else m[1:]
        return any(target.endswith("/" + rest + t) for t in graph.ALIAS_TAILS)
    name = m.split("/")[-1]
    return f"/{name}." in target or target.endswith((f"/{name}/index.ts", f"/{name}/index.js"))


def test_repo_edges(spark, files):
    df = spark.createDataFrame(files, SCHEMA)
    got = sorted((r.analysis_id, r.source, r.target, r.type) for r in graph.edges_repo(graph.imports_repo(df), df).collect())
    want = {}
    for repo, _, source, code in files:
        for m in named(code, False):
            for other, _, target, _ in files:
                if other == repo and target != source and fits(source, m, target):
                    kind = "require" if m.startswith("@") else "import"
                    want.setdefault((repo, source, target), kind)
    assert got == sorted((*k, v) for k, v in want.items())
    assert len(want) > 100


def test_dots_lead_somewhere_only_when_asked(spark):
    df = spark.createDataFrame(
        [("r", 0, "src/a/one.ts", "import x from '../b/two';\nimport y from './three';"),
         ("r", 1, "src/b/two.ts", ""), ("r", 2, "src/a/three/index.js", "")], SCHEMA)
    imports = graph.imports_repo(df)
    assert graph.edges_repo(imports, df).count() == 0
    found = graph.edges_repo(imports, df, resolve_dots=True).collect()
    assert sorted(r.target for r in found) == ["src/a/three/index.js", "src/b/two.ts"]


def test_coupling_and_sizes(spark):
    edges = spark.createDataFrame(
        [("p", "a", t, 0) for t in "bcdef"] + [("p", "b", t, 1) for t in "cde"] + [("p", "c", "d", 2)],
        "analysis_id string, source string, target string, source_ord int")
    rows = sorted((r.source, r.n_edges, r.severity, r.source_ord) for r in graph.coupling(edges).collect())
    assert rows == [("a", 5, "high", 0), ("b", 3, "medium", 1)]
    [size] = graph.graph_sizes(edges).collect()
    assert (size.n_nodes, size.n_edges) == (6, 9)


def test_salted_joins_send_no_table_through_the_driver(spark):
    few = spark.range(2000).withColumnRenamed("id", "key")
    met = salted_join(few, few.selectExpr("key", "key % 7 AS row"), ["key"], spread_by="row")
    assert sorted(r.key for r in met.collect()) == list(range(2000))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
