"""Repeat marks that forget: against a plain walk, over restarts, with late requests."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from inkbar.streaming import recent
from inkbar.streaming import stream as st

SCHEMA = "req_id long, text string, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def plain_marks(rows, limit):
    last, out = {}, {}
    for i, text, m in sorted(rows, key=lambda r: (r[2] is None, r[2], r[0])):
        out[i] = m is not None and text in last and m - last[text] <= limit
        if m is not None:
            last[text] = m
    return out


def run(spark, folder, limit="30 minutes", delay="10 minutes"):
    """One drained run over what is new in the folder; its marks so far and its last progress."""
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder / "in"))
    marks = recent.stream_mark_recent(stream, limit, delay)
    q = st.start_to_files(marks, str(folder / "out"), str(folder / "cp"))
    assert q.awaitTermination(180)
    got = spark.read.schema(recent.MARKS).parquet(str(folder / "out")).collect()
    return {r.req_id: r.cached for r in got}, len(got), q.recentProgress


def put(spark, folder, rows, files=1):
    table = spark.createDataFrame([(i, t, at(m)) for i, t, m in rows], SCHEMA)
    table.repartition(files).write.mode("append").parquet(str(folder / "in"))


def test_marks_equal_a_plain_walk_over_restarts_and_the_state_is_bounded(spark, tmp_path):
    first = [(i, "hot" if i % 3 else f"t{i % 11}", i * 2) for i in range(120)] + [(500, "hot", None), (501, "t3", None)]
    put(spark, tmp_path, first, 3)
    got, n, _ = run(spark, tmp_path)
    assert got == plain_marks(first, 30) and n == len(first)
    # a restart from the checkpoint goes on with what is remembered
    second = [(200, "hot", 250), (201, "t1", 250), (202, "fresh", 251), (203, "fresh", 251), (204, "hot", 400), (205, "hot", 429)]
    put(spark, tmp_path, second)
    got, n, _ = run(spark, tmp_path)
    assert got == plain_marks(first + second, 30) and n == len(first + second)
    # long after, everything but the last request is forgotten
    third = [(300, "alone", 10_000)]
    put(spark, tmp_path, third)
    got, n, progress = run(spark, tmp_path)
    assert got == plain_marks(first + second + third, 30)
    put(spark, tmp_path, [(301, "alone", 10_001)])
    got, _, progress = run(spark, tmp_path)
    rows = [p["stateOperators"][0]["customMetrics"] for p in progress if p["stateOperators"]]
    assert got[301] is True and rows
    states = spark.read.format("statestore").option("stateVarName", "asked").load(str(tmp_path / "cp"))
    assert states.count() == 1


def test_late_requests_are_marked_by_what_is_remembered(spark, tmp_path):
    put(spark, tmp_path, [(1, "a", 0), (2, "b", 1000)])
    run(spark, tmp_path)
    # the watermark stands at minute 990; "a" is forgotten, "b" remembered from 1000 on
    put(spark, tmp_path, [(3, "a", 5), (4, "b", 700), (5, "c", 800), (6, "c", 801)])
    got, n, _ = run(spark, tmp_path)
    assert n == 6 and got == {1: False, 2: False, 3: False, 4: True, 5: False, 6: True}
    put(spark, tmp_path, [(7, "c", 802), (8, "b", 1029)])  # "c" is remembered until the watermark moves on
    got, n, _ = run(spark, tmp_path)
    assert n == 8 and got[8] is True and got[7] is True
    put(spark, tmp_path, [(9, "c", 803)])
    got, n, _ = run(spark, tmp_path)
    assert n == 9 and got[9] is False


def test_runs_of_a_batch():
    b = pd.DataFrame({"req_id": [5, 3, 9, 4, 8, 7], "fp": list("aabaaa"), "at": [10.0, 0, 5, 40, 10, None]})
    (out,) = recent.runs_of_batch(15)(iter([b]))
    got = {r.req_id: (r.lane > 0, r.lane) for r in out.itertuples()}
    assert got[3][1] == got[4][1] == got[9][1] == 0 and got[7][1] == -1 and got[5][0] and got[8][0]
    assert out.set_index("req_id").loc[3, "until"] == 10


def test_batch_tables_are_told_alike(spark):
    rows = [(i, f"x{i % 2}", at(i * 20)) for i in range(6)]
    table = spark.createDataFrame(rows, SCHEMA)
    keys = recent.with_fingerprint(table).select("req_id", "fp", F.unix_micros("ts").alias("at"))
    laned = keys.coalesce(1).mapInPandas(recent.runs_of_batch(45 * 60 * 10**6), recent._RUNS).collect()
    assert sorted(r.req_id for r in laned if r.lane == 0) == [0, 1]
