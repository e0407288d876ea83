"""The store of buckets and deltas against a dictionary; broken saves, replays, rivals, files opened."""

import random

import pytest

from reviewloom.sources import upserts

SCHEMA = "analysis_id string, at long, v string"


def rows_of(df):
    return {r.analysis_id: (r["at"], r.v) for r in df.collect()}


def test_equals_a_dictionary(spark, tmp_path):
    path, rng, want = str(tmp_path / "store"), random.Random(5), {}
    for batch in range(5):
        rows = [(rng.choice([None, *(f"id{i}" for i in range(40))]), rng.randrange(9), f"b{batch}-{i}") for i in range(30)]
        upserts.upsert(spark.createDataFrame(rows, SCHEMA), path, ["at"], bits=2)
        last = {}
        for row in rows:
            last[row[0]] = max(last.get(row[0], (-1, "")), row[1:])
        want |= last
        if batch in (1, 3):
            upserts.compact(spark, path)
        found = upserts.read(spark, path)
        assert found.columns == ["analysis_id", "at", "v"] and found.count() == len(want)
        assert rows_of(found) == want
    asked = spark.createDataFrame([("id1",), ("nobody",), ("id1",), (None,)], "analysis_id string")
    for most in (10_000, 0):
        got = {r.analysis_id: (r["at"], r.v) if r.found else None for r in upserts.get(asked, path, most).collect()}
        assert got == {"id1": want.get("id1"), "nobody": None, None: want.get(None)}


def test_untouched_buckets_stay(spark, tmp_path):
    path = str(tmp_path / "store")
    upserts.upsert(spark.range(500).selectExpr("'id' || id AS analysis_id", "id AS at", "'x' AS v"), path, ["at"])
    upserts.compact(spark, path)
    before = upserts.manifest(spark, path).snapshots
    upserts.upsert(spark.createDataFrame([("id7", 1000, "new")], SCHEMA), path, ["at"])
    upserts.compact(spark, path)
    after = upserts.manifest(spark, path).snapshots
    assert len(before) > 50 and sum(before[b] != after[b] for b in before) == 1
    assert rows_of(upserts.read(spark, path))["id7"] == (1000, "new")


def test_lookup_opens_few_files(spark, tmp_path):
    path = str(tmp_path / "store")
    for _ in range(2):
        upserts.upsert(spark.range(2000).selectExpr("'id' || id AS analysis_id", "id AS at", "'x' AS v"), path, ["at"])
    asked = spark.createDataFrame([("id3",), ("id1999",)], "analysis_id string")
    opened = upserts.get(asked, path).inputFiles()
    everything = upserts.read(spark, path).inputFiles()
    assert 2 <= len(set(opened)) <= 4 < len(set(everything)) / 10


def test_broken_saves_and_replays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("a", 1, "one"), ("b", 1, "one")], SCHEMA)
    second = spark.createDataFrame([("b", 2, "two"), ("c", 2, "two")], SCHEMA)
    assert upserts.upsert(first, path, ["at"], batch_id=0)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(upserts, "_commit", broken)
        with pytest.raises(OSError):
            upserts.upsert(second, path, ["at"], batch_id=1)
    assert rows_of(upserts.read(spark, path)) == {"a": (1, "one"), "b": (1, "one")}
    assert upserts.upsert(second, path, ["at"], batch_id=1)
    assert not upserts.upsert(first, path, ["at"], batch_id=1)
    want = {"a": (1, "one"), "b": (2, "two"), "c": (2, "two")}
    assert rows_of(upserts.read(spark, path)) == want
    assert rows_of(upserts.read(spark, path, number=1)) == {"a": (1, "one"), "b": (1, "one")}
    # What the broken save wrote goes, what a manifest names stays.
    assert upserts.vacuum(spark, path, keep=1) == 1
    assert rows_of(upserts.read(spark, path)) == want


def test_rival_writers(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1, "one")], SCHEMA)
    upserts.upsert(rows, path, ["at"])
    with pytest.raises(FileExistsError):
        upserts._commit(spark, path, upserts.Manifest(1))
    with pytest.raises(ValueError, match="other columns"):
        upserts.upsert(rows.withColumnRenamed("v", "w"), path, ["at"])
    with pytest.raises(FileNotFoundError):
        upserts.read(spark, str(tmp_path / "none"))


def test_empty_save(spark, tmp_path):
    path = str(tmp_path / "store")
    upserts.upsert(spark.createDataFrame([], SCHEMA), path, ["at"])
    assert upserts.read(spark, path).count() == 0
    upserts.compact(spark, path)
    assert upserts.read(spark, path).count() == 0
