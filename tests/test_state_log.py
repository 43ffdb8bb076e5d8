"""The life of patients' states in the log."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources.state_log import StateLog

SCHEMA = "patient_id string, payload map<string,string>, timestamp timestamp"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def rows(spark, *items):
    return spark.createDataFrame([(p, x, None if m is None else at(m)) for p, x, m in items], SCHEMA)


@pytest.fixture
def log(spark, tmp_path):
    return StateLog(spark, str(tmp_path / "states"))


def test_create_update_and_list(spark, log):
    log.create(rows(spark, ("P001", {"current_glucose": "123.0", "stress_level": "7"}, 0)))
    assert log.state("P001").current_glucose == 123.0
    log.update(rows(spark, ("P001", {"carbs_on_board": "20.0", "activity_level": "15", "unknown": "1"}, 5)))
    state = log.state("P001")
    assert (state.current_glucose, state.carbs_on_board, state.activity_level, state.stress_level, state.version) == (123.0, 20.0, 15, 7, 2)
    assert state.timestamp == at(5) and state.last_meal_time is None
    log.create(rows(spark, ("P001", {"current_glucose": "1.0"}, 6), ("P000", None, 6)))  # a second create changes nothing
    assert log.state("P001") == state and [r.patient_id for r in log.patients().collect()] == ["P000", "P001"]
    assert (log.state("P000").current_glucose, log.state("P000").stress_level) == (100.0, 5)
    with pytest.raises(KeyError):
        log.state("P404")


def test_states_persist(spark, log):
    log.create(rows(spark, ("P002", {"current_glucose": "145.0", "stress_level": "4"}, 0)))
    log.update(rows(spark, ("P002", {"insulin_on_board": "2.5"}, 1)))
    state = StateLog(spark, log.path).state("P002")
    assert (state.current_glucose, state.insulin_on_board, state.stress_level) == (145.0, 2.5, 4)


def test_events_are_recorded(spark, log):
    log.create(rows(spark, ("P003", {}, 0)))
    log.append(rows(spark, ("P003", {"predicted_glucose": "160.0"}, 1)).withColumn("event_type", F.lit("simulation")))
    reviewed = spark.createDataFrame([("P003", "doctor_approval", "Reviewed", {"risk_level": "AMAN"}, at(2)), ("P004", "call", "New", None, at(3))], "patient_id string, intervention_type string, summary string, details map<string,string>, timestamp timestamp")
    log.intervene(reviewed)
    log.update(rows(spark, ("P003", {"current_glucose": None}, 4)))
    events = log.events().orderBy("patient_id", "version").collect()
    assert [(e.patient_id, e.version, e.event_type) for e in events] == [("P003", 1, "create"), ("P003", 2, "simulation"), ("P003", 3, "intervention"), ("P003", 4, "update"), ("P004", 1, "create"), ("P004", 2, "intervention")]
    assert events[2].payload == {"intervention_type": "doctor_approval", "summary": "Reviewed", "details": '{"risk_level":"AMAN"}'}
    assert events[0].previous is None and events[3].previous.current_glucose == 100.0
    assert log.state("P003").current_glucose is None and log.state("P003").version == 4  # a written null is a value


def test_snapshot_and_tail(spark, log):
    assert log.states().count() == 0
    log.update(rows(spark, ("a", {"current_glucose": "1"}, 1), ("a", {"current_glucose": "2"}, 0), (None, {}, 0), ("b", {"stress_level": "9"}, None)))
    before = log.states().orderBy("patient_id").collect()
    assert [(r.patient_id, r.version, r.current_glucose, r.stress_level) for r in before] == [("a", 3, 1.0, 5), ("b", 2, 100.0, 9)]
    number = log.snapshot()
    assert log.states().orderBy("patient_id").collect() == before
    log.update(rows(spark, ("a", {"carbs_on_board": "7"}, 9), ("c", {}, 9)))
    after = {r.patient_id: (r.version, r.current_glucose, r.carbs_on_board) for r in log.states().collect()}
    assert after == {"a": (4, 1.0, 7.0), "b": (2, 100.0, 0.0), "c": (2, 100.0, 0.0)}
    assert log.states(upto=number).orderBy("patient_id").collect() == before and log.events().count() == 8


def test_a_broken_commit_is_put_aside(spark, log):
    log.create(rows(spark, ("a", {}, 0)))
    with open(f"{log.path}/commits/2", "w") as f:
        f.write('{"snap')
    assert log.states().count() == 1 and log.commits.newest() == 1
    assert log.update(rows(spark, ("a", {"stress_level": "3"}, 1))) == 2 and log.state("a").stress_level == 3
    with pytest.raises(Exception, match="exist"):
        log.commits.add(2, {"snapshot": 0})
