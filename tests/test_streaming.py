"""Streams against the same work on tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reviewloom.sources import landed, store
from reviewloom.streaming.dedup import BLOCK, accepted, first_sights, start_dedup, take_batch
from reviewloom.streaming.results import batch_results, start_results
from reviewloom.streaming.scan import scan_submissions, start_scan

DIFF = "diff --git a/x.ts b/x.ts\n@@ -1 +1 @@\n+eval(a)\n"


def land(spark, path):
    rows = [
        (f"s{i}", None, DIFF if i % 2 else None, None if i % 2 else "eval(1)\nvar a", None, None) for i in range(6)
    ] + [("bad", None, None, " ", None, None)]
    df = spark.createDataFrame(rows, landed.SUBMISSION_SCHEMA)
    for i in range(3):
        df.filter(F.pmod(F.hash("analysis_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(path)
    return df


def same(a, b):
    key = sorted(a.columns)
    return sorted(map(str, a.select(key).collect())) == sorted(map(str, b.select(key).collect()))


def test_scan_of_a_stream(spark, tmp_path):
    df = land(spark, str(tmp_path / "in"))
    stream = landed.submission_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    start_scan(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3 * 2 + 3 and same(out, scan_submissions(df))


def test_results_of_a_stream(spark, tmp_path):
    df = land(spark, str(tmp_path / "in"))
    stream = landed.submission_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    start_results(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = store.load(spark, str(tmp_path / "out")).drop("batch_id")
    assert out.count() == 6 and same(out, batch_results(df))


def test_an_id_that_comes_again_has_its_last_result(spark, tmp_path):
    for i, code in enumerate(["eval(1)", "one\ntwo"]):
        rows = [("again", None, None, code, None, None), (f"once{i}", None, None, "x", None, None)]
        df = spark.createDataFrame(rows, landed.SUBMISSION_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = landed.submission_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
        start_results(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.analysis_id: r.total_additions for r in store.load(spark, str(tmp_path / "out")).collect()}
    assert got == {"again": 2, "once0": 1, "once1": 1}
    store.compact(spark, str(tmp_path / "out"), str(tmp_path / "small"))
    assert same(store.load(spark, str(tmp_path / "small")), store.load(spark, str(tmp_path / "out")))


START = dt.datetime(2024, 1, 1)


def sights(spark, folder, portions, key=("k",)):
    """Accepted (key, minute) of portions of (key, minute), each a batch of its own; minute None is no time."""
    n = 0
    for portion in portions:
        rows = [
            (n + i, None if m is None else START + dt.timedelta(minutes=m), k, 1) for i, (k, m) in enumerate(portion)
        ]
        n += len(rows)
        schema = "id long, ts timestamp, k string, u int"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        start_dedup(stream, f"{folder}/out", f"{folder}/state", list(key), "ts", "id").awaitTermination()
    rows = accepted(spark, f"{folder}/out").collect()
    return sorted(((r.k, (r.accepted_at - START).total_seconds() / 60) for r in rows), key=lambda r: (r[0] or "", r[1]))


def rule(events, last=None):
    kept = []
    for minute in sorted(events):
        if last is None or minute > last + 5:
            kept.append(minute)
            last = minute
    return kept


def test_first_sights_across_batches(spark, tmp_path):
    portions = [[("a", 0), ("a", 4), ("b", 0)], [("a", 20), ("b", 5), ("a", 3)], [("a", 30), ("a", 31), ("b", 5.5)]]
    # Exactly five minutes later is still a repeat, and so is what comes late.
    assert sights(spark, str(tmp_path), portions) == [("a", 0), ("a", 20), ("a", 30), ("b", 0), ("b", 5.5)]


def test_dense_keys_bursts_and_rows_without_a_time(spark, tmp_path):
    r = random.Random(2)
    dense = [("dense", i / 10) for i in range(3000)]
    burst = [("burst", 7.0)] * 500 + [("burst", 100 + r.randrange(240) / 60) for _ in range(500)]
    sparse = [(f"s{i % 7}", r.randrange(120_000) / 60) for i in range(700)]
    events = dense + burst + sparse
    r.shuffle(events)
    got = sights(spark, str(tmp_path), [[*events, ("none", None), (None, 3), (None, 4)]], ("k", "u"))
    want = [(k, m) for k in {k for k, _ in events} for m in rule([m for n, m in events if n == k])]
    assert [(k, round(m, 3)) for k, m in got if k is not None] == sorted((k, round(m, 3)) for k, m in want)
    assert [m for k, m in got if k is None] == [3]
    assert [x.k for x in spark.read.parquet(f"{tmp_path}/out/rejects").collect()] == ["none"]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, START, "a"), (2, START + dt.timedelta(minutes=9), "a")], "id long, ts timestamp, k string")
    args = (f"{tmp_path}/out", f"{tmp_path}/state", ["k"], "ts", "id")
    for batch_id in (0, 1, 1):
        take_batch(batch, batch_id, *args)
    assert [r.row_id for r in accepted(spark, f"{tmp_path}/out").orderBy("row_id").collect()] == [1, 2]


def test_the_split_into_batches_does_not_matter(spark, tmp_path):
    events = [("a", m) for m in (0, 3, 6, 60, 64, 66, 300)] + [("b", m) for m in (1, 200)]
    late = [events[6:] + events[3:5], events[:3], events[5:6]]
    assert sights(spark, str(tmp_path), late) == [("a", 0), ("a", 6), ("a", 60), ("a", 66), ("a", 300), ("b", 1), ("b", 200)]


def plain(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [2, 3, 16])
def test_first_sights_in_blocks_follow_the_rule(spark, block):
    r = random.Random(block)
    events = {"steady": [i for i in range(4000)], "edges": [300 * i for i in range(60)], "steps": [301 * i for i in range(60)]}
    events["near"] = sorted({int(300 * i + r.choice([-1, 0, 1, 150])) for i in range(200)})
    for n in range(12):
        at, times = 0, []
        for _ in range(150):
            at += r.choice([1, 40, 299, 300, 301, 700, 5000]) if n % 2 else r.randrange(1, 400)
            times.append(at)
        events[f"k{n}"] = times
    rows = [(k, (t - 9000) * 1_000_000, f"{k}{t}{c}") for k, times in events.items() for t in times for c in "ba"]
    df = spark.createDataFrame(rows, "key string, micros long, row_id string").repartition(3)
    state = spark.createDataFrame([("k1", -9000 * 1_000_000 + 55), ("k2", 10**15), ("new", 0)], "key string, last long")
    got = plain(first_sights(df, state, block=block))
    want = []
    for k, times in events.items():
        last = {"k1": -9000 * 1_000_000 + 55, "k2": 10**15}.get(k)
        for t in sorted(times):
            micros = (t - 9000) * 1_000_000
            if last is None or micros > last + 300_000_000:
                want.append((k, micros, f"{k}{t}a"))
                last = micros
    assert got == sorted(want)
    assert first_sights(df.limit(0), state, block=block).count() == 0


def test_a_key_that_is_never_silent_takes_many_tasks(spark):
    times = spark.range(200_000).select(F.lit("hot").alias("key"), (F.col("id") * 1_000_000).alias("micros"), F.col("id").alias("row_id"))
    found = first_sights(times, times.select("key", F.col("micros").alias("last")).limit(0))
    assert [r.row_id for r in found.orderBy("row_id").collect()] == list(range(0, 200_000, 301))
    sizes = times.groupBy(F.expr(f"micros div {300_000_000 * BLOCK}").alias("block")).count()
    assert sizes.count() == 42 and sizes.agg(F.max("count")).first()[0] == 4800  # the unit of work, not the key


def settle(spark, folder, batches, lateness):
    schema = "id long, ts timestamp, k string"
    for n, batch in enumerate(batches):
        df = spark.createDataFrame([(i, None if m is None else START + dt.timedelta(minutes=m), k) for i, k, m in batch], schema)
        args = (n, f"{folder}/out", f"{folder}/state/rows", ["k"], "ts", "id", lateness)
        take_batch(df, *args)
        if n % 3 == 1:
            take_batch(df, *args)  # the batch runs again
    return plain(accepted(spark, f"{folder}/out", checkpoint=f"{folder}/state").select("k", "row_id"))


def test_settling_as_the_watermark_passes(spark, tmp_path):
    r = random.Random(4)
    events = sorted(((f"k{r.randrange(3)}", r.randrange(6000) / 10) for _ in range(500)), key=lambda e: e[1] + r.random() * 25)
    rows = [(i, k, m) for i, (k, m) in enumerate(events)]
    want = []
    for key in ("k0", "k1", "k2"):
        first = {}
        for i, k, m in rows:
            if k == key:
                first.setdefault(m, i)
        want += [(key, first[m]) for m in rule(first)]
    split = [rows[i : i + 100] for i in range(0, 500, 100)]
    assert settle(spark, f"{tmp_path}/many", split, 1800) == sorted(want)
    assert settle(spark, f"{tmp_path}/one", [rows], 1800) == sorted(want)
    waiting = spark.read.parquet(f"{tmp_path}/many/state/rows/open/batch=4")
    span = waiting.agg(F.max("micros") - F.min("micros")).first()[0]
    assert waiting.count() < 120 and span <= 1800 * 1_000_000  # bounded by the lateness, not by what came
    assert spark.read.parquet(f"{tmp_path}/many/state/rows/last/batch=4").count() <= 3
    assert sorted(p.name for p in (tmp_path / "many/state/rows/open").iterdir()) == ["batch=3", "batch=4"]


def test_what_comes_too_late_is_rejected(spark, tmp_path):
    batches = [[(1, "a", 0), (2, "a", 100)], [(3, "a", 10), (4, "a", None), (5, "b", 99)], [], [(6, "a", 104), (7, "a", 106)]]
    assert settle(spark, tmp_path, batches, 600) == [("a", 1), ("a", 2), ("a", 7), ("b", 5)]
    assert sorted(x.row_id for x in spark.read.parquet(f"{tmp_path}/out/rejects").collect()) == [3, 4]
    assert settle(spark, f"{tmp_path}/none", [[], []], 600) == []
