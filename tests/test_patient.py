"""Patients' states and their texts."""

import random

import duckdb
import pytest
from compare import same
from pyspark.sql import functions as F

from tidemark.operators import patient, text
from tidemark.plans import catalog


def test_numbers_as_python_writes_them(spark):
    rng = random.Random(8)
    values = [0.15, 0.35, 1234.45, 2.675, 0.5, 1.5, 2.5, -0.04, -0.05, 0.05, 1e-9, 0.0, 99.95, 123456789.125, 1e17, 5e15 + 0.5] + [rng.uniform(-500, 500) for _ in range(400)] + [rng.randint(-4000, 4000) / 8 for _ in range(200)] + [rng.randint(0, 4000) / 200 for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", *[text.fixed(F.col("x"), p).alias(f"p{p}") for p in (0, 1, 2)]).collect():
        assert (r.p0, r.p1, r.p2) == (f"{r.x:.0f}", f"{r.x:.1f}", f"{r.x:.2f}"), r.x
    none = spark.createDataFrame([(None,)], "x double").select(text.fixed(F.col("x"), 1).alias("a")).first()
    assert none.a is None


def one(spark, **fields):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()])
    return patient.patient_states(df)


def test_states_of_tables_with_few_columns(spark):
    s = one(spark, id=1).first()
    assert (s.patient_id, s.current_glucose, s.predicted_glucose, s.prediction_horizon_minutes, s.stress_level, s.activity_level, s.trend_direction, s.risk_level, s.urgency, s.anticipated_conditions) == ("unknown", 100.0, 100.0, 60, 5, 0, "stable", "normal", "low", ["normal"])
    s = one(spark, patient_id="p", current_glucose=5.0, predicted_glucose=900.0, insulin=-1.0, carbs_on_board="7.5", activity=12.9, stress=99, extra="x").first()
    assert (s.current_glucose, s.predicted_glucose, s.insulin_on_board, s.carbs_on_board, s.activity_level, s.stress_level, s.risk_level, s.extra) == (20.0, 600.0, 0.0, 7.5, 12, 10, "critical_hyperglycemia", "x")
    s = one(spark, predicted_glucose=120.0, predicted_condition="hypoglycemia", predicted_upper=181.0).first()
    assert (s.risk_level, s.risk_label, s.anticipated_conditions, s.urgency) == ("hypoglycemia", "BAHAYA - Hipoglikemia", ["hypoglycemia", "hyperglycemia"], "high")
    assert one(spark, predicted_glucose=40.0, predicted_condition="normal").first().risk_level == "critical_hypoglycemia"


def test_exported_fields(spark):
    s = one(spark, patient_id="p", timestamp="2024-01-01").select(patient.exported().alias("state"), patient.exported("context").alias("context")).first()
    assert list(s.state.asDict()) == list(patient.EXPORTED) and s.state.timestamp == "2024-01-01"
    assert s.context.asDict() == {"current_glucose": 100.0, "insulin_on_board": 0.0, "carbs_on_board": 0.0, "activity_level": 0, "stress_level": 5}


def test_answers_name_the_doctor(spark):
    df = spark.createDataFrame([(65.0, 90.0, 4, "BAHAYA"), (70.0, 90.0, 7, "AMAN"), (180.0, 90.0, 6, "AMAN"), (220.0, 190.0, 8, "HATI-HATI")], "g double, c double, s int, level string")
    for r in df.select("*", patient.template_answer(F.col("g"), F.col("c"), F.col("s")).alias("a"), patient.risk_level(F.col("g")).alias("risk")).collect():
        assert "dokter" in r.a.lower() and r.risk.startswith(r.level) and f"Status: {r.risk}." in r.a and ("Stres tinggi" in r.a) == (r.s >= 7)


def test_context_of_queries_with_and_without_documents(spark):
    queries = spark.createDataFrame([(1,), (2,)], "q int")
    docs = spark.createDataFrame([(1, 2, " b\n", None, None, "3"), (1, 1, "Pantau glukosa.", "manual_kb", 2024, None)], "q int, rank int, text string, source string, year int, page string")
    got = {r.q: r for r in text.context_of(queries, docs, "q", "rank").collect()}
    assert got[1].context == "1. Pantau glukosa. [manual_kb, 2024, Hal. N/A]\n\n2. b [Manual KB, N/A, Hal. 3]"
    assert [tuple(s) for s in got[1].sources] == [("manual_kb", "manual_kb", "2024", "N/A"), ("Manual KB", "Manual KB", "N/A", "3")]
    assert (got[2].context, got[2].sources) == (text.NO_CONTEXT, [])


def test_filters_and_modes(spark):
    for g, topic in ((40.0, "hipoglikemia"), (100.0, None), (200.0, "hiperglikemia")):
        tags = one(spark, predicted_glucose=g).select(patient.metadata_tags().alias("t")).first().t
        assert tags == {"jenis_dm": "dm_tipe2"} | ({"topik": topic} if topic else {})
    with pytest.raises(ValueError, match="no such mode"):
        patient.comparison_query("other", F.lit(1.0))


def test_scenarios_and_updates(spark):
    from tidemark.operators import twin

    state = spark.createDataFrame([("p", 100.0, 0.0, 0.0, 5.0, 0.0), ("q", 100.0, 1.0, 0.0, 2.0, 10.0)], "patient_id string, glucose double, insulin double, carbs double, stress double, activity double")
    meals = twin.compare_meals(state, [0.0, 30.0]).where("patient_id = 'p'").orderBy("carbs_grams").collect()
    assert [(r.carbs_grams, r.predicted_glucose, r.risk_level, r.risk_color) for r in meals] == [(0.0, 120.0, "AMAN", "green"), (30.0, 300.0, "HATI-HATI - Hiperglikemia", "orange")]
    assert twin.less_stress(state, 9).where("patient_id = 'q'").first().simulated.stress == 1
    walk = twin.exercise(state, 30).where("patient_id = 'p'").first()
    assert walk.predicted_glucose == 47.5 and walk.risk_color == "red" and walk.entry.event_type == "simulation" and '"minutes":90.0' in walk.entry.payload
    for wrong in (lambda: twin.compare_meals(state, [-1.0]), lambda: twin.less_stress(state, -1), lambda: twin.exercise(state, -1)):
        with pytest.raises(ValueError):
            wrong()
    updates = spark.createDataFrame([("p", 900.0, -3.0), ("x", 1.0, 1.0)], "patient_id string, glucose double, insulin double")
    got = {r.patient_id: r for r in twin.update_states(state, updates).collect()}
    assert sorted(got) == ["p", "q"] and (got["p"].glucose, got["p"].insulin, got["q"].insulin) == (400.0, 0.0, 1.0)
    dose = twin.recommend_dose(state, F.lit(45.0)).where("patient_id = 'p'").first()
    assert dose.recommended_dose == round(dose.recommended_dose, 1) and dose.difference == abs(dose.predicted_glucose - 120)

def test_negative_zero_keeps_its_sign(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (-0.004,)], "x double")
    got = [(r.two, r.none) for r in df.select(text.fixed(F.col("x"), 2).alias("two"), text.fixed(F.col("x"), 0).alias("none")).collect()]
    assert got == [(f"{x:.2f}", f"{x:.0f}") for x in (0.0, -0.0, -0.004)] == [("0.00", "0"), ("-0.00", "-0"), ("-0.00", "-0")]


def test_a_change_that_rounds_to_negative_zero_keeps_its_sign_behind_the_plus(spark):
    row = patient.patient_states(spark.createDataFrame([("a", 73.02, 73.02 - 1e-13)], "patient_id string, current_glucose double, predicted_glucose double"), 30)
    got = row.select(patient.conditioned_query(F.lit("?")).alias("q"), patient.context_block().alias("b")).first()
    assert "perubahan +-0.0 mg/dL" in got.q and "+-0.0 mg/dL (stabil" in got.b


def test_what_is_no_number_and_large_wholes_as_text(spark):
    xs = (float("nan"), float("inf"), -float("inf"), 2.0**53, -3.3e17 / 3, 2.0**62 + 1024)
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(text.fixed(F.col("x"), 1).alias("one"), text.fixed(F.col("x"), 0).alias("none")).collect()
    assert [tuple(r) for r in got] == [(f"{x:.1f}", f"{x:.0f}") for x in xs]


ODD = {
    "no_value": {"value": "CASE WHEN event_id % 17 <> 0 THEN value END"},
    "no_number": {"value": "CASE event_id % 17 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value END"},
    "no_patient": {"user_id": "CASE WHEN event_id % 17 <> 0 THEN user_id END"},
    "no_time": {"ts": "CASE WHEN event_id % 17 <> 0 THEN ts END"},
    "no_id": {"event_id": "CASE WHEN event_id % 17 <> 0 THEN event_id END"},
    "negative_ids": {"event_id": "event_id - 500"},
    "copies": {"event_id": "event_id + k * 1000"},
}


@pytest.mark.parametrize("kind", sorted(ODD))
def test_conditioned_queries_of_odd_events_match_sql(spark, tmp_path, kind):
    columns = ", ".join(f"{ODD[kind].get(c, c)} AS {c}" for c in ("event_id", "ts", "user_id", "event_type", "value", "props"))
    duckdb.sql(f"COPY (SELECT {columns} FROM '/root/testdata/sf0.001/events.parquet', range({6 if kind == 'copies' else 1}) t(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    same(spark, catalog.queries()["conditioned_queries"], catalog.oracle_sql()["conditioned_queries"], str(tmp_path))
