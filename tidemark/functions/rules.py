"""Column rules: zones, error grid, trend, risk, urgency, on-board amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the clinical ladders (mg/dL, minutes, counts).
LOW, HIGH, VERY_LOW, VERY_HIGH = 70, 180, 54, 250
STABLE, RAPID = 10, 30
INSULIN_FACTOR, CARB_FACTOR, STRESS_FACTOR, ACTIVITY_FACTOR = 50.0, 3.0, 2.0, 1.5


def clamp(x: Column, lo: float, hi: float) -> Column:
    """``x`` within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def zone(g: Column) -> Column:
    """hypo below 70, hyper above 180, else (null included) normal."""
    return F.when(g < LOW, "hypo").when(g > HIGH, "hyper").otherwise("normal")


def error_zone(truth: Column, predicted: Column) -> Column:
    """Simplified error grid, first match wins; null when either side is."""
    inside = lambda x: (x >= LOW) & (x <= HIGH)
    a = ((truth < LOW) & (predicted < LOW)) | (F.abs(truth - predicted) <= 0.2 * truth)
    c = ((truth < LOW) & (predicted > HIGH)) | ((truth > HIGH) & (predicted < LOW))
    grid = F.when(a, "A").when(inside(truth) & inside(predicted), "B").when(c, "C").when(inside(predicted) & ~inside(truth), "D").otherwise("E")
    return F.when(truth.isNotNull() & predicted.isNotNull(), grid)


def delta(current: Column, predicted: Column) -> Column:
    return F.bround(predicted - current, 2)


def trend(d: Column) -> Column:
    return F.when(F.abs(d) < STABLE, "stable").when(d > 0, "rising").otherwise("falling")


def pace(d: Column) -> Column:
    return F.when(F.abs(d) >= RAPID, "rapid").when(F.abs(d) >= STABLE, "moderate").otherwise("slow")


def risk(predicted: Column) -> Column:
    return F.when(predicted < VERY_LOW, "critical_hypoglycemia").when(predicted < LOW, "hypoglycemia").when(predicted > VERY_HIGH, "critical_hyperglycemia").when(predicted > HIGH, "hyperglycemia").otherwise("normal")


#: Names of the risks.
RISK_NAMES = {"critical_hypoglycemia": "BAHAYA - Hipoglikemia Berat", "hypoglycemia": "BAHAYA - Hipoglikemia", "critical_hyperglycemia": "BAHAYA - Hiperglikemia Berat", "hyperglycemia": "HATI-HATI - Hiperglikemia", "normal": "AMAN"}


def risk_name(risk_: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RISK_NAMES.items() for x in kv])[risk_]


def with_class(risk_: Column, label: Column) -> Column:
    """A classifier's label in place of a risk that is not critical; unknown labels change nothing."""
    named = F.when(label == "hypo", "hypoglycemia").when(label == "hyper", "hyperglycemia").when(label == "normal", "normal")
    return F.when(risk_.startswith("critical"), risk_).otherwise(F.coalesce(named, risk_))


def conditions(risk_: Column, lower: Column, upper: Column) -> Column:
    """Conditions to expect, ordered hypoglycemia, hyperglycemia, normal."""
    base = F.regexp_replace(risk_, "^critical_", "")
    keep = F.array(
        F.when((base == "hypoglycemia") | (lower < LOW), "hypoglycemia"),
        F.when((base == "hyperglycemia") | (upper > HIGH), "hyperglycemia"),
        F.when(base == "normal", "normal"),
    )
    return F.filter(keep, lambda x: x.isNotNull())


def urgency(risk_: Column, pace_: Column, stress: Column) -> Column:
    high = risk_.isin("hypoglycemia", "hyperglycemia") | (pace_ == "rapid")
    return F.when(risk_.startswith("critical"), "critical").when(high, "high").when(stress >= 8, "medium").otherwise("low")


def early_warning(label: Column, predicted: Column, lower: Column) -> Column:
    """A: the classifier sees hypoglycemia the forecast does not; B: only the interval reaches it."""
    return F.when((label == "hypo") & (predicted >= LOW), "A").when((lower < LOW) & (predicted >= LOW), "B")


def insulin_on_board(hours: Column, dose: Column) -> Column:
    """Half-life of two hours, nothing after four."""
    return F.when(hours >= 4, F.lit(0.0)).otherwise(dose * F.exp(-F.ln(F.lit(2.0)) / 2 * hours))


def carbs_on_board(hours: Column, carbs: Column) -> Column:
    """Linear over three hours."""
    return F.when(hours >= 3, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), carbs - carbs / 3 * hours))


def project(glucose: Column, insulin: Column, carbs: Column, stress: Column, activity: Column, minutes: Column) -> Column:
    """Glucose after some minutes of a constant state, within 40 and 400."""
    change = -insulin * INSULIN_FACTOR + carbs * CARB_FACTOR + stress * STRESS_FACTOR - activity * ACTIVITY_FACTOR
    return clamp(glucose + change * minutes / 60, 40.0, 400.0)


def valid_glucose(g: Column) -> Column:
    return g > 0


def meal_type(carbs: Column) -> Column:
    return F.when(carbs > 0, "meal").otherwise("none")


def low_weight(truth: Column, weight: float) -> Column:
    """The training weight of a reading: ``weight`` below 80, else 1."""
    return F.when(truth < 80, F.lit(weight)).otherwise(F.lit(1.0))


def arrow(change: Column) -> Column:
    """The display's trend; unlike :func:`trend` a change of exactly 10 is stable."""
    return F.when(change > STABLE, "up").when(change < -STABLE, "down").otherwise("stable")
