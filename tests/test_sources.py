"""Landed snapshots, routing, selection and the store."""

import base64
import json

from pyspark.sql import functions as F

from reviewloom.operators import routing, rollups, selection
from reviewloom.sources import landed, store


def test_pages_become_files(spark, tmp_path):
    def file(i):
        return {"filename": f"f{i}.py", "status": "added", "additions": i, "deletions": 0, "changes": i,
                **({"patch": f"@@ {i}"} if i % 2 else {})}

    with open(tmp_path / "pages.json", "w") as out:
        for page in (2, 1):
            items = [file(i) for i in (range(100) if page == 1 else range(100, 103))]
            out.write(json.dumps({"analysis_id": "p", "page": page, "body": json.dumps(items)}) + "\n")
    rows = landed.pr_files(landed.pages(spark, str(tmp_path))).orderBy("file_ord").collect()
    assert [r.path for r in rows] == [f"f{i}.py" for i in range(103)]
    assert rows[1].patch == "@@ 1" and rows[2].patch is None


def test_broken_bodies(spark):
    def faults(kind, *bodies):
        df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "analysis_id int, body string")
        return [r.fault for r in landed.with_fault(df, kind).orderBy("analysis_id").collect()]

    wrong = ["empty", "empty", "not json", "other shape"]
    message = '{"message":"rate limit"}'
    assert faults("pr_files", None, " \n", '[{"filename":"a"', message, "[]", '[{"filename":"a"}]') == [*wrong, None, None]
    assert faults("pr_files", "[1]", "[null]", '[{"filename":"a","additions":"x"}]', '[{"filename":"a"}] x') == ["other shape"] * 4
    assert faults("pr_header", None, "", "{", message, '{"title":""}', '{"title":"t","additions":"x"}') == [*wrong, None, "other shape"]
    assert faults("repo_info", None, "", "{", message, '{"full_name":"o/r","x":1}') == [*wrong, None]
    tree = '{"tree":[{"path":"a","type":"blob"}],"truncated":%s}'
    assert faults("tree", None, "", "{", message, "[]", tree % "false", tree % "true", '{"tree":[{"path":"a","size":"big"}]}') == [
        *wrong, "other shape", None, "truncated", "other shape"]
    assert faults("languages", None, "", "{", message, "{}", '{"Go":1}', '{"Go":"x","C":1}') == [*wrong, None, None, "other shape"]

    df = spark.createDataFrame([("cut", tree % "true"), ("bad", message)], "analysis_id string, body string")
    assert [r.analysis_id for r in landed.sound(df, "tree").collect()] == ["cut"]
    assert [(r.analysis_id, r.body) for r in landed.rejects(df, "tree").collect()] == [("bad", message)]


def test_incomplete_lists(spark):
    def page(n):
        return json.dumps([{"filename": f"f{i}"} for i in range(n)])

    rows = [("whole", 1, page(100)), ("whole", 2, page(3)), ("gap", 1, page(100)), ("gap", 4, page(100)),
            ("headless", 2, page(1)), ("short", 1, page(99)), ("short", 2, page(100)),
            ("twice", 1, page(5)), ("twice", 1, page(5)), ("cut", 1, page(100)[:50]), ("cut", 2, page(1))]
    df = spark.createDataFrame(rows, "analysis_id string, page int, body string")
    got = sorted((r.analysis_id, r.page, r.fault) for r in landed.page_faults(df).collect())
    assert got == [("cut", 1, "not json"), ("gap", 4, "missing before"), ("headless", 2, "missing before"),
                   ("short", 1, "short"), ("twice", 1, "repeated")]
    # An error message is not a file without a name.
    assert landed.pr_files(spark.createDataFrame([("e", 1, '{"message":"x"}')], df.schema)).count() == 0
    assert landed.page_faults(df.limit(0)).count() == 0


def test_tree_info_and_languages(spark):
    def raw(body):
        return spark.createDataFrame([("r", json.dumps(body))], "analysis_id string, body string")

    items = landed.tree(raw({"sha": "1", "tree": [{"path": "a", "type": "tree"}, {"path": "a/x.py", "type": "blob", "size": 5}]}))
    assert [(r.path, r["size"]) for r in selection.tree_blobs(items).collect()] == [("a/x.py", 5)]
    info = landed.repo_info(raw({"name": "n", "full_name": "o/n", "description": None, "topics": ["t"], "size": 3})).first()
    assert (info.full_name, info.topics, info.description) == ("o/n", ["t"], None)
    languages = landed.repo_languages(raw({"Go": 10, "C": 30, "Zig": 30}))
    stats = rollups.language_stats(languages, 2).orderBy("rank").collect()
    assert [(r.language, r.percentage, r.color) for r in stats] == [("C", 42.9, "#555555"), ("Zig", 42.9, "#6B7280")]
    header = landed.pr_headers(raw({"title": "t", "user": {"login": "u"}, "head": {"sha": "s"}})).first()
    assert (header.title, header.user.login, header.head.sha) == ("t", "u", "s")


def test_contents_are_decoded(spark):
    text = "café  \n" * 20
    coded = base64.b64encode(text.encode()).decode()
    wrapped = "\n".join(coded[i:i + 60] for i in range(0, len(coded), 60))
    url_safe = base64.urlsafe_b64encode(b"\xfb\xff\xfe>>>").decode()
    rows = [("wrapped", wrapped, "base64"), ("bare", coded.rstrip("="), "base64"), ("none", "x", "none"),
            ("empty", "", "base64"), ("null", None, "base64"), ("odd", "YWJjZ", "base64"), ("bad", url_safe, "base64")]
    df = spark.createDataFrame(rows, "path string, content string, encoding string")
    got = {r.path: r.content for r in landed.file_contents(df).collect()}
    assert got == {"wrapped": text, "bare": text, "odd": "abc", "bad": b"\xfb\xff\xfe>>>".decode("utf-8", "replace")}


def test_checkout(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\ny = 2\n")
    [row] = landed.checkout(spark, str(tmp_path)).collect()
    assert row.path.endswith("src/a.py") and row.content == "x = 1\ny = 2\n"


def test_checkout_by_bytes(spark, tmp_path):
    text = "zwölf Öfen\nügen"
    files = {
        "a.py": text.encode(), "b/bom.py": b"\xef\xbb\xbf" + text.encode(), "b/little.py": b"\xff\xfe" + (text + "😀").encode("utf-16-le"),
        "b/c/big end.py": b"\xfe\xff" + (text + "😀").encode("utf-16-be"), "latin.py": text.encode("latin-1"), "empty.py": b"",
        "zero.py": b"ab\0cd", "odd.py": b"\xff\xfea\0b", "lone.py": b"\xfe\xff\xd8\x00\x00a", "late.py": b"x" * 8000 + b"\0",
        "large.py": b"x" * 20_001, "long.py": b"\xff\xfe" + ("ab" * 4000).encode("utf-16-le"), "other.txt": b"not asked for",
    }
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.path: r for r in landed.checkout_files(spark, str(tmp_path), "*.py", 20_000).collect()}
    assert set(got) == set(files) - {"other.txt", "empty.py"} and all(r.size == len(files[p]) for p, r in got.items())
    assert {p: (r.encoding, r.content) for p, r in got.items() if r.kind == "text"} == {
        "a.py": ("UTF-8", text), "b/bom.py": ("UTF-8", text), "b/little.py": ("UTF-16LE", text + "😀"),
        "b/c/big end.py": ("UTF-16BE", text + "😀"), "latin.py": ("ISO-8859-1", text),
        "late.py": ("UTF-8", "x" * 8000 + "\0"), "long.py": ("UTF-16LE", "ab" * 4000),
    }
    assert {p: r.kind for p, r in got.items() if r.content is None} == {
        "zero.py": "binary", "odd.py": "binary", "lone.py": "binary", "large.py": "too large",
    }


def test_a_checkout_of_many_folders_is_listed_in_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.py").write_text(f"x = {i}")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(key), spark.sparkContext.statusTracker()
    for name, reader in (("bytes", landed.checkout_files), ("text", landed.checkout)):
        spark.sparkContext.setJobGroup(f"list-{name}", name)
        found = reader(spark, str(tmp_path))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = [s for j in tracker.getJobIdsForGroup(f"list-{name}") for s in tracker.getJobInfo(j).stageIds]
        assert stages and all(tracker.getStageInfo(s).numTasks <= 4 * spark.sparkContext.defaultParallelism for s in stages)
        assert {r.content for r in found.collect()} == {f"x = {i}" for i in range(100)}
    assert spark.conf.get(key) == before


def test_routes(spark):
    base = "https://github.com/o/r"
    diff = "diff --git a/x b/x\n@@ -1 +1 @@\n+a"
    rows = [
        ("code", base, diff, "x = 1"), ("diff", base, diff, " \n"), ("url", base + ".git", "no diff", None),
        ("pull", base + "/pull/7/files", None, None), ("zero", base + "/pull/0", None, None),
        ("none", "", None, None), ("null", None, "no diff", ""), ("other", "https://example.com/o/r", None, None),
        ("short", "https://github.com/o", None, None),
    ]
    df = spark.createDataFrame(rows, "analysis_id string, url string, diff string, code string")
    got = {r.analysis_id: (r.kind, r.reject_reason) for r in routing.route(df).collect()}
    assert got == {
        "code": ("code", None), "diff": ("diff", None), "url": ("repo", None), "pull": ("pr", None),
        "zero": (None, "undetermined"), "none": (None, "no url or diff"), "null": (None, "no url or diff"),
        "other": (None, "not recognised"), "short": (None, "not recognised"),
    }
    parsed = {r.url: (r.type, r.owner, r.repo, r.pr_number) for r in routing.parse_urls(df.select("url")).collect()}
    assert parsed[base + ".git"] == ("repo", "o", "r.git", None)
    assert parsed[base + "/pull/7/files"] == ("pr", "o", "r", 7)


def test_selection(spark):
    rows = [("r", i, f"f{i}.{'py' if i % 2 else 'md'}", "blob", i * 1000) for i in range(60)]
    rows += [("r", 60, "big.py", "blob", 500_000), ("r", 61, "new.py", "blob", None), ("r", 62, "pic.PNG", "blob", 1),
             ("r", 63, "x.", "blob", 1), ("r", 64, "dir.py", "tree", 499_999)]
    tree = spark.createDataFrame(rows, "analysis_id string, file_ord int, path string, type string, size int")
    chosen = selection.scan_candidates(tree).orderBy("scan_ord").collect()
    assert [r.path for r in chosen] == [f"f{i}.py" for i in range(59, 29, -2)]
    kept = {r.path for r in selection.repo_files(tree).collect()}
    assert {"big.py", "new.py"} <= kept and not {"pic.PNG", "x.", "dir.py"} & kept
    files = spark.createDataFrame(
        [("p", i, f"f{i}", i % 3, None if i == 5 else "" if i == 8 else "x") for i in range(30)],
        "analysis_id string, file_ord int, path string, changes int, patch string")
    fetched = selection.pr_candidates(files, 5).orderBy("scan_ord").collect()
    assert [r.file_ord for r in fetched] == [2, 11, 14, 17, 20]


def test_store(spark, tmp_path):
    saves = spark.createDataFrame(
        [("a", 1, "v1"), ("b", 2, "v2"), ("a", 9, "v3"), ("c", 3, "v4")], "analysis_id string, at int, v string")
    kept = store.retain_latest(saves, ["at"], 2).collect()
    assert [(r.analysis_id, r.v) for r in kept] == [("c", "v4"), ("b", "v2")]
    asked = spark.createDataFrame([("a",), ("z",), ("a",)], "analysis_id string")
    found = sorted((r.analysis_id, r.v, r.found) for r in store.lookup(asked, store.latest(saves, ["at"]).select("analysis_id", "v")).collect())
    assert found == [("a", "v3", True), ("z", None, False)]
    results = saves.withColumn("kind", F.lit("code"))
    path = str(tmp_path / "results")
    for _ in range(2):
        store.save(results, path, batch_id=0)
    store.save(results.limit(1), path, batch_id=1)
    assert spark.read.parquet(path).count() == 5
    assert store.load(spark, path).count() == 3


def test_folders(spark):
    files = spark.createDataFrame(
        [("r", 0, "src/b.py", 1), ("r", 1, "src/lib", 2), ("r", 2, "src/lib/c.go", 3), ("r", 3, "A.md", 4), ("r", 4, "src/a.py", 5)],
        "analysis_id string, file_ord int, path string, size int")
    tree = rollups.folder_tree(files)
    rows = {r.path: (r.parent, r.name, r.node_type, r.depth, r.child_count, r.language, r["size"]) for r in tree.collect()}
    assert rows == {
        "": (None, "/", "folder", 0, 2, None, None),
        "src": ("", "src", "folder", 1, 3, None, None),
        "src/b.py": ("src", "b.py", "file", 2, 0, "Python", 1),
        "src/lib": ("src", "lib", "file", 2, 1, "LIB", 2),
        "src/lib/c.go": ("src/lib", "c.go", "file", 3, 0, "Go", 3),
        "src/a.py": ("src", "a.py", "file", 2, 0, "Python", 5),
        "A.md": ("", "A.md", "file", 1, 0, "Markdown", 4),
    }
    shown = [r.path for r in rollups.listed(tree).collect() if r.parent == "src"]
    assert shown == ["src/a.py", "src/b.py", "src/lib"]
    assert [r.name for r in rollups.first_root_nodes(tree, 5).orderBy("pos").collect()] == ["src", "A.md"]
