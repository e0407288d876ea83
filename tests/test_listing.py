"""Display positions against a walk over the tree."""

import random

from reviewloom.operators import listing, rollups

SCHEMA = "analysis_id string, file_ord int, path string, size int"


def walked(nodes):
    """Paths in the order of a depth-first walk; names are plain, so that code points sort as people do."""
    below = {}
    for path, (parent, name, kind) in nodes.items():
        if parent is not None:
            below.setdefault(parent, []).append((kind != "folder", name, path))
    out, todo = [], [""]
    while todo:
        path = todo.pop()
        out.append(path)
        todo += [p for _, _, p in sorted(below.get(path, []), reverse=True)]
    return out


def listing_of(spark, rows):
    tree = rollups.folder_tree(spark.createDataFrame(rows, SCHEMA))
    found = listing.display_positions(tree).collect()
    trees, shown = {}, {}
    for r in found:
        trees.setdefault(r.analysis_id, {})[r.path] = (r.parent, r.name, r.node_type)
        shown.setdefault(r.analysis_id, {})[r.pos] = r.path
    return trees, shown


def test_equals_a_walk(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        path = "/".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6)))
        rows.append((rng.choice(["r", "r", "s"]), i, path, i))  # many are files and folders at once
    trees, shown = listing_of(spark, rows)
    for analysis, nodes in trees.items():
        assert sorted(shown[analysis]) == list(range(1, len(nodes) + 1))
        assert [shown[analysis][i + 1] for i in range(len(nodes))] == walked(nodes)


def test_as_people_sort(spark):
    names = ["Zoo.py", "apple.py", "Äpfel.py", "b/x.py", "b.py", "file10", "file1"]
    _, shown = listing_of(spark, [("r", i, n, 1) for i, n in enumerate(names)])
    assert [shown["r"][i] for i in range(1, 10)] == ["", "b", "b/x.py", "Äpfel.py", "apple.py", "b.py", "file1", "file10", "Zoo.py"]


def test_empty(spark):
    assert listing_of(spark, []) == ({}, {})
