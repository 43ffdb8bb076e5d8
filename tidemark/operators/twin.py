"""What-if projections of a patient's state and the fold of its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import HIGH, LOW, RISK_NAMES, clamp, project, risk
from .blocks import free
from .text import exact_round

RATIO, CORRECTION = 10.0, 50.0


def check_scenario(scenario: dict) -> dict:
    """The scenario with defaults; wrong kinds and values raise."""
    if not isinstance(scenario, dict):
        raise TypeError("a scenario is a dict")
    s = {"carbs": 0.0, "insulin": 0.0, "stress": 0.0, "activity": 0.0, "minutes": 60} | scenario
    if s["minutes"] <= 0 or s["carbs"] < 0 or s["insulin"] < 0:
        raise ValueError("minutes must be positive, carbs and insulin not negative")
    return s


def normalise_state(df: DataFrame) -> DataFrame:
    """Defaults and bounds of the state columns ``glucose, insulin, carbs, stress, activity``."""
    c = lambda n, d: F.coalesce(F.col(n), F.lit(d))
    return df.withColumns({"glucose": clamp(c("glucose", 100.0), 40.0, 400.0), "insulin": F.greatest(F.lit(0.0), c("insulin", 0.0)), "carbs": F.greatest(F.lit(0.0), c("carbs", 0.0)), "stress": clamp(c("stress", 5.0).cast("int"), 1, 10), "activity": F.greatest(F.lit(0), c("activity", 0.0).cast("int"))})


def what_if(states: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Each state under each of a few scenarios: ``scenario, projected, risk``."""
    checked = [check_scenario(s) for s in scenarios]
    items = F.array(*[F.struct(F.lit(i).alias("scenario"), *[F.lit(float(s[c])).alias(c) for c in ("carbs", "insulin", "stress", "activity", "minutes")]) for i, s in enumerate(checked)])
    df = normalise_state(states).withColumn("s", F.explode(items))
    p = project(F.col("glucose"), F.col("insulin") + F.col("s.insulin"), F.col("carbs") + F.col("s.carbs"), clamp(F.col("stress") + F.col("s.stress"), 1.0, 10.0), F.greatest(F.lit(0.0), F.col("activity") + F.col("s.activity")), F.col("s.minutes"))
    return df.withColumn("projected", p).withColumns({"scenario": F.col("s.scenario"), "risk": risk(F.col("projected"))}).drop("s")


def best_dose(states: DataFrame, carbs: Column, target: float = 120.0, minutes: float = 120.0, points: int = 20, places: int | None = 1) -> DataFrame:
    """The first of ``points`` doses around ``carbs / 10`` whose projection lies nearest the target."""
    df = normalise_state(states).withColumn("_c", carbs.cast("double"))
    dose = lambda i: F.col("_c") / RATIO * (0.5 + i / (points - 1.0))
    p = lambda i: project(F.col("glucose"), F.col("insulin") + dose(i), F.col("carbs") + F.col("_c"), F.col("stress"), F.col("activity"), F.lit(minutes))
    tries = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(F.abs(p(i) - target).alias("miss"), i.alias("i"), dose(i).alias("dose"), p(i).alias("projected")))
    return df.withColumn("_t", F.array_min(tries)).select("*", (F.col("_t.dose") if places is None else F.bround("_t.dose", places)).alias("dose"), F.col("_t.projected").alias("dose_projected")).drop("_t", "_c")


def decision_rules(df: DataFrame) -> DataFrame:
    """One row per rule that fires."""
    g, s, a = F.col("glucose"), F.col("stress"), F.col("activity")
    rules = F.array(F.when(g > 180, "HIGH: high glucose"), F.when(s > 7, "MEDIUM: stress"), F.when(a < 15, "MEDIUM: inactivity"), F.when((g >= 70) & (g <= 180) & (s <= 6), "LOW: in range"))
    return df.withColumn("rule", F.explode(F.filter(rules, lambda x: x.isNotNull())))


def fold_events(events: DataFrame, by: str, seq: list[str], keys: dict[str, str], present: dict[str, Column]) -> DataFrame:
    """Current state: for each key the last event that wrote it, explicit nulls included.

    ``keys`` maps state keys to value columns, ``present`` says whether an event writes the key. Partial aggregates do the fold.
    """
    at = F.struct(*seq)
    return events.groupBy(by).agg(*[F.max_by(F.when(present[k], F.struct(F.col(v).alias("v"))), F.when(present[k], at)).getField("v").alias(k) for k, v in keys.items()], F.count("*").alias("n_events"))


def newest(events: DataFrame, by: str, seq: list[str], cap: int = 1000) -> DataFrame:
    """The newest ``cap`` events of each patient."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in seq])
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def state_history(events: DataFrame, by: str, seq: list[str], keys: dict[str, str], present: dict[str, Column]) -> DataFrame:
    """Every event with the state after it and ``previous``, the state before (null for a patient's first event).

    An event that does not write a key leaves it; one that writes null overwrites it. One sorted window serves all keys.
    """
    w = Window.partitionBy(by).orderBy(*seq)
    after = {k: F.last(F.when(present[k], F.struct(F.col(v).alias("v"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k, v in keys.items()}
    out = events.withColumns({f"_{k}": c for k, c in after.items()})
    state = F.struct(*[F.col(f"_{k}.v").alias(k) for k in keys])
    return out.withColumn("previous", F.lag(state).over(w)).withColumns({k: F.col(f"_{k}.v") for k in keys}).drop(*[f"_{k}" for k in keys])


def summary(states: DataFrame) -> DataFrame:
    """States as texts."""
    shown = lambda c, places, unit: F.format_string(f"%.{places}f{unit}", F.col(c).cast("double"))
    return states.select("patient_id", shown("glucose", 1, " mg/dL").alias("current_glucose"), shown("insulin", 2, " units").alias("insulin_active"), shown("carbs", 1, " grams").alias("carbs_active"), shown("stress", 0, "/10").alias("stress_level"), shown("activity", 0, " minutes").alias("activity_level"))


def simulate(states: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Each state under each of a few scenarios, as a result is reported.

    ``scenario`` is its place in the list; ``current_glucose, predicted_glucose, glucose_change``; ``risk_level`` and ``risk_color``;
    ``simulated``, the changed state; ``entry``, the event that a history keeps of it (type and payload as JSON).
    """
    checked = [check_scenario(s) for s in scenarios]
    fields = ("carbs", "insulin", "stress", "activity", "minutes")
    items = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(s[c])).alias(c) for c in fields]) for i, s in enumerate(checked)])
    (name,) = free(states, "s")
    df = normalise_state(states).withColumn(name, F.explode(items))
    s = F.col(name)
    changed = {"insulin": F.greatest(F.lit(0.0), F.col("insulin") + s["insulin"]), "carbs": F.greatest(F.lit(0.0), F.col("carbs") + s["carbs"]), "stress": clamp((F.col("stress") + s["stress"]).cast("int"), 1, 10), "activity": F.greatest(F.lit(0.0), F.col("activity") + s["activity"])}
    p = project(F.col("glucose"), changed["insulin"], changed["carbs"], changed["stress"], changed["activity"], s["minutes"])
    df = df.withColumn("predicted_glucose", p)
    p = F.col("predicted_glucose")
    df = df.withColumns({
        "scenario": s["i"],
        "current_glucose": F.col("glucose"),
        "glucose_change": p - F.col("glucose"),
        "risk_level": F.when(p < LOW, RISK_NAMES["hypoglycemia"]).when(p > HIGH, RISK_NAMES["hyperglycemia"]).otherwise(RISK_NAMES["normal"]),
        "risk_color": F.when(p < LOW, "red").when(p > HIGH, "orange").otherwise("green"),
        "simulated": F.struct(F.col("glucose").alias("current_glucose"), *[c.alias(k) for k, c in changed.items()], p.alias("predicted_glucose")),
    })
    result = F.struct("current_glucose", "predicted_glucose", "glucose_change", "risk_level", "risk_color", "simulated")
    payload = F.to_json(F.struct(F.struct(*[s[c].alias(c) for c in fields]).alias("scenario"), result.alias("result")))
    return df.withColumn("entry", F.struct(F.lit("simulation").alias("event_type"), payload.alias("payload"))).drop(name)


def compare_meals(states: DataFrame, carbs: list[float]) -> DataFrame:
    """Every state two hours after meals of some sizes: ``carbs_grams, predicted_glucose, glucose_change, risk_level``."""
    if any(c < 0 for c in carbs):
        raise ValueError("meals have no negative carbohydrates")
    grams = F.element_at(F.array(*[F.lit(float(c)) for c in carbs]), F.col("scenario") + 1)
    return simulate(states, [{"carbs": c, "minutes": 120} for c in carbs]).withColumn("carbs_grams", grams)


def less_stress(states: DataFrame, points: int = 3) -> DataFrame:
    """Every state an hour after its stress fell by some points."""
    if points < 0:
        raise ValueError("stress falls by no negative number")
    return simulate(states, [{"stress": -points, "minutes": 60}])


def exercise(states: DataFrame, minutes: int = 30) -> DataFrame:
    """Every state an hour and a half after some minutes of exercise."""
    if minutes < 0:
        raise ValueError("exercise has no negative duration")
    return simulate(states, [{"activity": minutes, "minutes": 90}])


def recommend_dose(states: DataFrame, carbs: Column, target: float = 120.0) -> DataFrame:
    """The dose for a meal (:func:`best_dose`): ``recommended_dose`` with one decimal, ``meal_carbs, predicted_glucose, target_glucose, difference``."""
    (meal,) = free(states, "meal")
    df = best_dose(states.withColumn(meal, carbs.cast("double")), F.col(meal), target, places=None)
    shown = exact_round(F.col("dose"), 1)
    return df.withColumns({"recommended_dose": shown, "meal_carbs": F.col(meal), "predicted_glucose": F.col("dose_projected"), "target_glucose": F.lit(target), "difference": F.abs(F.col("dose_projected") - target)}).drop(meal, "dose", "dose_projected")


def update_states(states: DataFrame, updates: DataFrame, by: str = "patient_id") -> DataFrame:
    """States with the columns of ``updates`` that they have (one row a patient; a null changes nothing), brought within bounds again.

    Patients without an update stay; updates of patients without a state are left out.
    """
    keys = [c for c in updates.columns if c != by and c in states.columns]
    joined = states.alias("s").join(updates.alias("u"), by, "left")
    return normalise_state(joined.select(by, *[(F.coalesce(F.col(f"u.{c}").cast(states.schema[c].dataType), F.col(f"s.{c}")) if c in keys else F.col(f"s.{c}")).alias(c) for c in states.columns if c != by]))
