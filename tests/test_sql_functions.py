"""The SQL functions against the column rules, on a grid and on nulls."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, sql

GRID = [None, 19.0, 53.9, 54.0, 69.9, 70.0, 100.0, 180.0, 180.1, 250.0, 250.1, 700.0]
RISKS = [None, "critical_hypoglycemia", "hypoglycemia", "critical_hyperglycemia", "hyperglycemia", "normal"]


@pytest.fixture(scope="module")
def registered(spark):
    sql.register(spark)
    return spark


@pytest.mark.parametrize(
    ("call", "rule"),
    [
        ("glucose_in_range(x)", lambda x, y: rules.clamp(x, 20.0, 600.0)),
        ("glucose_zone(x)", lambda x, y: rules.zone(x)),
        ("glucose_error_zone(x, y)", rules.error_zone),
        ("glucose_trend(x - y)", lambda x, y: rules.trend(x - y)),
        ("glucose_pace(x - y)", lambda x, y: rules.pace(x - y)),
        ("glucose_risk(x)", lambda x, y: rules.risk(x)),
        ("risk_name(glucose_risk(x))", lambda x, y: rules.risk_name(rules.risk(x))),
        ("expected_conditions(glucose_risk(x), y - 20, y + 20)", lambda x, y: rules.conditions(rules.risk(x), y - 20, y + 20)),
        ("risk_urgency(glucose_risk(x), glucose_pace(x - y), CAST(y / 10 AS INT))", lambda x, y: rules.urgency(rules.risk(x), rules.pace(x - y), (y / 10).cast("int"))),
        ("glucose_warning(glucose_zone(y), x, y)", lambda x, y: rules.early_warning(rules.zone(y), x, y)),
        ("risk_with_class(glucose_risk(x), glucose_zone(y))", lambda x, y: rules.with_class(rules.risk(x), rules.zone(y))),
        ("insulin_on_board(x / 50, y)", lambda x, y: rules.insulin_on_board(x / 50, y)),
        ("carbs_on_board(x / 50, y)", lambda x, y: rules.carbs_on_board(x / 50, y)),
        ("glucose_after(x, y / 100, y / 10, 5, 30, 60)", lambda x, y: rules.project(x, y / 100, y / 10, F.lit(5.0), F.lit(30.0), F.lit(60.0))),
    ],
)
def test_functions_are_the_rules(registered, call, rule):
    df = registered.createDataFrame(list(itertools.product(GRID, GRID)), "x double, y double")
    for r in df.select("x", "y", F.expr(call).alias("a"), rule(F.col("x"), F.col("y")).alias("b")).collect():
        assert r.a == r.b if not isinstance(r.b, float) else r.a == pytest.approx(r.b), r


def test_table_functions(registered):
    got = registered.sql("SELECT * FROM dose_grid(40D, 5) ORDER BY i").collect()
    assert [(r.i, r.dose) for r in got] == [(0, 2.0), (1, 3.0), (2, 4.0), (3, 5.0), (4, 6.0)]
    got = registered.sql("SELECT t.x, o.* FROM VALUES (10D), (300D) t(x), LATERAL patient_outlook(100D, t.x, 5) o ORDER BY x").collect()
    assert [(r.trend, r.pace, r.risk, r.urgency) for r in got] == [("falling", "rapid", "critical_hypoglycemia", "critical"), ("rising", "rapid", "critical_hyperglycemia", "critical")]


def test_rules_reach_the_optimizer(registered):
    plan = registered.sql("SELECT glucose_zone(CAST(50 AS DOUBLE)) AS z FROM range(3)")._jdf.queryExecution().optimizedPlan().toString()
    assert "hypo AS z" in plan


def test_chunks_of_odd_texts(registered):
    registered.createDataFrame([(1, None), (2, ""), (3, " a  b\nc "), (None, "x y"), (4, "w " * 2000)], "doc_id long, text string").createOrReplaceTempView("odd_texts")
    got = registered.sql("SELECT doc_id, pos, chunk FROM chunk_words(TABLE(odd_texts) PARTITION BY (doc_id), 2, 1)").collect()
    by_doc = {i: [r.chunk for r in sorted(got, key=lambda r: r.pos) if r.doc_id == i] for i in (None, 1, 2, 3, 4)}
    assert by_doc[3] == ["a b", "b c", "c"] and by_doc[None] == ["x y", "y"] and len(by_doc[4]) == 2000 and not by_doc[1] and not by_doc[2]
