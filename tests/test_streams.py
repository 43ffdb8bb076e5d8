"""Stateful streams with late rows, copies, nulls and expiry."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import events, state

SCHEMA = "slice int, patient string, at timestamp, id long, v double, w boolean"


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def run(spark, rows, slices, **options):
    df = spark.createDataFrame([(i, p, None if h is None else at(h), e, v, w) for i, p, h, e, v, w in rows], SCHEMA)
    job = lambda s: state.state_changes(s, "patient", "at", "id", {"g": "v"}, {"g": F.col("w")}, **options)
    out = state.replay(df, F.col("slice"), slices, job, partitions=1).orderBy("batch", "patient", "at", "seq").collect()
    return [(r.patient, r.seq, r.g, r.previous_g, r.n_events, r.expired) for r in out]


def test_late_copies_and_written_nulls(spark):
    rows = [
        (0, "a", 0, 1, 5.0, True), (0, "a", 0, 1, 5.0, True), (0, "a", 2, 3, None, True), (0, None, 1, 9, 1.0, True), (0, "b", None, 9, 1.0, True),
        (1, "a", 1, 2, 7.0, True), (1, "a", 2, 3, None, True), (1, "a", 30, 4, 8.0, False), (1, "a", 31, 5, None, None),
        (2, "a", 0, 6, 1.0, True), (2, "a", 32, 7, 2.0, True),
    ]
    assert run(spark, rows, 3, late="10 hours") == [
        ("a", 1, 5.0, None, 1, False), ("a", 3, None, 5.0, 2, False),  # a copy counts once; a written null is a value
        ("a", 2, None, None, 3, False),  # arrives after a newer one and changes nothing
        ("a", 4, None, None, 4, False), ("a", 5, None, None, 5, False),  # they don't write the key
        ("a", 7, 2.0, None, 6, False),  # event 6 is older than the watermark
    ]


def test_idle_patients_expire(spark):
    rows = [(0, "a", 0, 1, 5.0, True), (0, "b", 1, 2, 6.0, True), (1, "b", 40, 3, 7.0, True), (2, "a", 41, 4, 1.0, False), (3, "b", 90, 5, 1.0, True)]
    got = run(spark, rows, 4, late="1 hour", idle=datetime.timedelta(hours=10))
    assert ("a", None, 5.0, 5.0, 1, True) in got
    assert ("a", 4, None, None, 1, False) in got  # it starts anew
    assert ("b", 3, 7.0, None, 1, False) in got or ("b", 3, 7.0, 6.0, 2, False) in got


@pytest.mark.parametrize("kind", ["windows", "sessions"])
def test_windows_and_sessions_drop_late_rows(spark, kind):
    rows = [(0, "a", 1, 1, 1.0, True), (0, "a", 40, 2, 2.0, True), (1, "a", 2, 3, 100.0, True), (1, "a", 41, 4, 4.0, True), (1, None, 400, 9, None, None)]
    df = spark.createDataFrame([(i, p, at(h), e, v, w) for i, p, h, e, v, w in rows], SCHEMA)
    job = (lambda s: events.windowed(s, "at", "patient", "v", late="5 hours")) if kind == "windows" else (lambda s: events.sessions(s, "at", "patient", late="5 hours"))
    got = state.replay(df, F.col("slice"), 2, job, partitions=1).where("patient is not null")
    assert sorted(r.n for r in got.collect()) == [1, 2]
    if kind == "windows":
        assert sorted(r.total for r in got.collect()) == [1.0, 6.0]


def test_replay_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    job = lambda s: state.state_changes(s, "patient", "at", "id", {"g": "v"}, {"g": F.col("w")})
    assert state.replay(df, state.spans(df, "at", 2), 2, job, partitions=1).count() == 0


def test_partitions_of_the_state_grow_with_the_rows(spark, monkeypatch):
    used, whole = [], state.run_to_end
    monkeypatch.setattr(state, "ROWS", 10, raising=False)
    monkeypatch.setattr(state, "run_to_end", lambda *a: (used.append(a[-1]), whole(*a)))
    rows = [(i % 2, f"p{i % 5}", i, i, float(i), True) for i in range(25)]
    df = spark.createDataFrame([(i, p, at(h), e, v, w) for i, p, h, e, v, w in rows], SCHEMA)
    job = lambda s: state.state_changes(s, "patient", "at", "id", {"g": "v"}, {"g": F.col("w")}, late="9 days")
    got = state.replay(df, F.col("slice"), 2, job, partitions=1).orderBy("patient", "at", "seq").collect()
    assert used == [3, 3] and sorted(r.seq for r in got) == list(range(25))
