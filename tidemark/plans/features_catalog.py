"""Queries over readings: ingest, engineered features, gaps, windows, rules and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import features, splits, temporal
from ..sources import readers
from ..streaming import events
from .catalog import _P, _R, _TOL, _W, _ZONE, ON, pairs, query, r6, readings, rounded

#: The events' kinds in the roles of channels.
ROLES = {"view": "glucose_level", "click": "meal", "purchase": "bolus", "error": "basal", "signup": "stressors"}
_ROLE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items()) + " END"


def channels(spark: SparkSession, d: str) -> DataFrame:
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return readings(spark, d).select("patient_id", role[F.col("channel")].alias("channel"), "timestamp", (F.col("glucose") - 5).alias("value"), "event_id")


_NEAR = f"""e AS (SELECT CAST(user_id AS VARCHAR) AS patient_id, {_ROLE} AS channel, ts, epoch_us(ts) AS us, value - 5 AS value, event_id FROM events), b AS (SELECT * FROM e WHERE channel = 'glucose_level' AND value > 0), l AS (SELECT * FROM e WHERE channel IN ('meal', 'bolus', 'stressors')),
back AS (SELECT l.event_id, b.event_id AS bid, l.us - b.us AS dist FROM l ASOF JOIN b ON l.patient_id = b.patient_id AND l.us >= b.us), ahead AS (SELECT l.event_id, b.event_id AS bid, b.us - l.us AS dist FROM l ASOF JOIN b ON l.patient_id = b.patient_id AND l.us <= b.us),
m AS (SELECT l.channel, l.value, CASE WHEN ahead.dist IS NULL OR back.dist <= ahead.dist THEN back.bid ELSE ahead.bid END AS bid, CASE WHEN ahead.dist IS NULL OR back.dist <= ahead.dist THEN back.dist ELSE ahead.dist END AS dist FROM l LEFT JOIN back USING (event_id) LEFT JOIN ahead USING (event_id)),
s AS (SELECT bid, sum(value) FILTER (WHERE channel = 'meal') AS meal, sum(value) FILTER (WHERE channel = 'bolus') AS bolus, max(CAST(channel = 'stressors' AS INT)) AS stress FROM m WHERE dist <= {_TOL} GROUP BY 1),
o AS (SELECT b.event_id, x.value AS rate FROM b ASOF LEFT JOIN (SELECT * FROM e WHERE channel = 'basal') x ON b.patient_id = x.patient_id AND b.ts >= x.ts)"""


@query(f"""WITH {_NEAR} SELECT b.event_id, b.value AS glucose, round(coalesce(meal, 0), 6) AS carbs, round(coalesce(bolus, 0) + coalesce(rate, 0) * 5 / 60, 6) AS insulin, round(coalesce(bolus, 0), 6) AS bolus_dose, coalesce(rate, 0) AS basal_rate, coalesce(stress, 0) AS stress, CASE WHEN coalesce(meal, 0) > 0 THEN 'meal' ELSE 'none' END AS meal_type
FROM b LEFT JOIN s ON s.bid = b.event_id JOIN o USING (event_id)""")
def ingest_readings(spark: SparkSession, d: str) -> DataFrame:
    out = temporal.assemble(channels(spark, d), tolerance_us=_TOL)
    return rounded(out.select("event_id", "glucose", "carbs", "insulin", "bolus_dose", "basal_rate", "stress", "meal_type"), "carbs", "insulin", "bolus_dose")


@query(f"""WITH {_R}, l AS (SELECT *, epoch_us(ts) AS us FROM r WHERE channel = 'error'), b AS (SELECT *, epoch_us(ts) AS us FROM r WHERE channel = 'view'),
back AS (SELECT l.event_id, b.event_id AS bid, b.glucose, l.us - b.us AS dist FROM l ASOF JOIN b ON l.patient_id = b.patient_id AND l.us >= b.us), ahead AS (SELECT l.event_id, b.event_id AS bid, b.glucose, b.us - l.us AS dist FROM l ASOF JOIN b ON l.patient_id = b.patient_id AND l.us <= b.us),
m AS (SELECT l.event_id, ahead.dist IS NULL OR back.dist <= ahead.dist AS b, back.bid AS b1, ahead.bid AS b2, back.glucose AS g1, ahead.glucose AS g2, back.dist AS d1, ahead.dist AS d2 FROM l LEFT JOIN back USING (event_id) LEFT JOIN ahead USING (event_id))
SELECT event_id, CASE WHEN CASE WHEN b THEN d1 ELSE d2 END <= {_TOL} THEN CASE WHEN b THEN g1 ELSE g2 END END AS iob, CASE WHEN CASE WHEN b THEN d1 ELSE d2 END <= {_TOL} THEN CAST(CASE WHEN b THEN b1 ELSE b2 END % 7 AS DOUBLE) END AS activity FROM m""")
def asof_context(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d)
    right = r.where("channel = 'view'").select("patient_id", "timestamp", F.col("event_id").alias("grid_id"), F.col("glucose").alias("iob"), (F.col("event_id") % 7).cast("double").alias("activity"))
    left = r.where("channel = 'error'").select("patient_id", "timestamp", "event_id")
    return temporal.asof_context(left, right, "patient_id", "timestamp", ["iob", "activity"], "event_id", "grid_id", _TOL).select("event_id", "iob", "activity")


def _sum(value: str, tau: float) -> str:
    return f"sum({value} * exp(n * {5 / tau!r})) {_W} * exp(-n * {5 / tau!r})"


_ENGINEERED = f"n AS (SELECT *, row_number() {_W} - 1 AS n FROM r), f AS (SELECT *, round({_sum('glucose', 240.0)}, 5) AS iob, round({_sum('(event_id % 40)', 180.0)}, 5) AS cob, round(coalesce(glucose - lag(glucose, 3) {_W}, 0), 6) + 0.0 AS glucose_trend, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) + 0.0 AS hour_cos FROM n)"


def engineered(spark: SparkSession, d: str) -> DataFrame:
    df = readings(spark, d).withColumns({"bolus_dose": F.col("glucose"), "insulin": F.lit(0.0), "carbs": F.col("event_id") % 40})
    out = features.engineer(df, "patient_id", tuple(ON))
    return out.withColumns({c: F.round(c, 5) for c in ("iob", "cob")} | {c: r6(c) for c in ("glucose_trend", "hour_sin", "hour_cos")})


@query(f"WITH {_R}, {_ENGINEERED} SELECT event_id, iob, cob, glucose_trend, hour_sin, hour_cos FROM f")
def engineer_features(spark: SparkSession, d: str) -> DataFrame:
    return engineered(spark, d).select("event_id", "iob", "cob", "glucose_trend", "hour_sin", "hour_cos")


@query(f"""WITH {_R}, {_ENGINEERED}, b AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY patient_id) AS c FROM f)
SELECT patient_id, round(sum(glucose), 4) AS total, round(max(CASE WHEN back = 1 THEN iob END), 5) AS iob_now, round(max(CASE WHEN back = 12 THEN cob END), 5) AS cob_first, CAST(12 AS BIGINT) AS n FROM b WHERE back <= 12 AND c >= 12 GROUP BY 1""")
def newest_window(spark: SparkSession, d: str) -> DataFrame:
    win = features.newest_windows(engineered(spark, d), "patient_id", ON, ["glucose", "iob", "cob", "glucose_trend"], 12)
    total = F.aggregate("x", F.lit(0.0), lambda s, c: s + c["glucose"])
    return win.select("patient_id", F.round(total, 4).alias("total"), F.round(F.element_at("x", -1)["iob"], 5).alias("iob_now"), F.round(F.element_at("x", 1)["cob"], 5).alias("cob_first"), F.size("x").cast("long").alias("n"))


def _filled(c: str) -> str:
    return f"coalesce({c}1 + ({c}2 - {c}1) * (rn - {c}a) / nullif({c}b - {c}a, 0), {c}1, {c}2)"


_GAPS = f"""h AS (SELECT event_id, patient_id, row_number() {_W} AS rn, CASE WHEN event_id % 5 < 2 THEN NULL ELSE glucose END AS u, CASE WHEN event_id % 7 < 3 THEN NULL ELSE glucose * 2 END AS v, CASE WHEN event_id % 3 = 0 THEN channel END AS s FROM r),
p AS (SELECT *, {", ".join(f"max(CASE WHEN {c} IS NOT NULL THEN rn END) OVER (PARTITION BY patient_id ORDER BY rn) AS {c}a, min(CASE WHEN {c} IS NOT NULL THEN rn END) OVER (PARTITION BY patient_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}b" for c in "uvs")} FROM h)"""


@query(f"""WITH {_R}, {_GAPS}, j AS (SELECT p.*, {", ".join(f"{c}x.{c} AS {c}1, {c}y.{c} AS {c}2" for c in "uvs")} FROM p {" ".join(f"LEFT JOIN h {c}{t} ON {c}{t}.patient_id = p.patient_id AND {c}{t}.rn = p.{c}{e}" for c in "uvs" for t, e in (("x", "a"), ("y", "b")))})
SELECT event_id, round({_filled("u")}, 6) AS u, round({_filled("v")}, 6) AS v, coalesce(s1, s2) AS s FROM j""")
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    df = readings(spark, d).withColumns({"u": F.when(i % 5 >= 2, F.col("glucose")), "v": F.when(i % 7 >= 3, F.col("glucose") * 2), "s": F.when(i % 3 == 0, F.col("channel"))})
    return rounded(features.fill_missing(df, "patient_id", ON, ["u", "v"], ["s"]).select("event_id", "u", "v", "s"), "u", "v")


@query(f"""WITH {_R}, c AS (SELECT *, CASE WHEN event_id % 23 = 0 THEN NULL ELSE glucose END AS g, row_number() {_W} AS rn FROM r), t AS (SELECT *, lead(g, 3) {_W} AS y FROM c),
s AS (SELECT event_id, y, rn, count(g) OVER (PARTITION BY patient_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS n, sum(g) OVER (PARTITION BY patient_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS total FROM t)
SELECT event_id, y, round(total, 6) AS total FROM s WHERE rn >= 6 AND y IS NOT NULL AND n = 6""")
def sparse_windows(spark: SparkSession, d: str) -> DataFrame:
    df = readings(spark, d).withColumn("g", F.when(F.col("event_id") % 23 != 0, F.col("glucose")))
    win = features.finite_windows(features.windows(df, "patient_id", ON, ["g"], "g", 6, 3), ["g"])
    return win.select("event_id", "y", r6(F.aggregate("x", F.lit(0.0), lambda s, c: s + c["g"])).alias("total"))


@query(f"""WITH {_R}, c AS (SELECT *, row_number() {_W} AS rn, lead(1, 6) {_W} AS more FROM r), k AS (SELECT a.event_id, b.glucose AS g, b.rn - a.rn AS o FROM c a JOIN c b ON a.patient_id = b.patient_id AND b.rn BETWEEN a.rn - 11 AND a.rn WHERE a.rn >= 12 AND a.more IS NOT NULL), m AS (SELECT avg(g) AS mu, stddev_pop(g) AS sd FROM k)
SELECT event_id, round(sum((g - mu) / sd), 4) + 0.0 AS total, round(max(CASE WHEN o = 0 THEN (g - mu) / sd END), 4) + 0.0 AS now FROM k, m GROUP BY 1""")
def scale_apply(spark: SparkSession, d: str) -> DataFrame:
    win = features.windows(readings(spark, d), "patient_id", ON, ["glucose"], "glucose", 12, 6)
    out = features.apply_scaler(win, features.pooled_scaler(win, ["glucose"]), ["glucose"])
    return out.select("event_id", r6(F.aggregate("x", F.lit(0.0), lambda s, c: s + c["glucose"]), 4).alias("total"), r6(F.element_at("x", -1)["glucose"], 4).alias("now"))


@query(f"""WITH {_P} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'meal' ELSE 'none' END AS meal_type, CASE WHEN y < 80 THEN 6.0 ELSE 1.0 END AS weight, CASE WHEN y - p > 10 THEN 'up' WHEN y - p < -10 THEN 'down' ELSE 'stable' END AS arrow, round(y - p, 6) + 0.0 AS target FROM v WHERE y > 0""")
def row_rules(spark: SparkSession, d: str) -> DataFrame:
    y, change = F.col("y"), F.col("y") - F.col("p")
    df = pairs(spark, d).where(rules.valid_glucose(y))
    return df.select("event_id", rules.meal_type((F.col("event_id") % 3 == 0).cast("int")).alias("meal_type"), rules.low_weight(y, 6.0).alias("weight"), rules.arrow(change).alias("arrow"), r6(change).alias("target"))


@query("SELECT event_type AS channel, CAST(count(*) FILTER (WHERE CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE ELSE value END IS NULL OR event_id % 10 = 0) AS BIGINT) AS n_bad, CAST(count(DISTINCT user_id) AS BIGINT) AS patients, round(avg(value) FILTER (WHERE event_id % 9 <> 0 AND event_id % 10 <> 0), 6) AS mean FROM events GROUP BY 1")
def finite_check(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("event_id") % 9 == 0, None).when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("glucose"))
    ok = features.finite(F.col("x"))
    return readings(spark, d).withColumn("x", x).groupBy("channel").agg(F.count_if(~ok).alias("n_bad"), F.countDistinct("patient_id").alias("patients"), r6(F.avg(F.when(ok, F.col("x")))).alias("mean"))


@query(f"WITH {_R} SELECT event_id, glucose FROM r WHERE patient_id = '7' AND ts IN (SELECT ts FROM r WHERE glucose > 20)")
def patient_semi_join(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d)
    return readers.patient_data(r, "7").join(r.where("glucose > 20").select("timestamp"), "timestamp", "left_semi").select("event_id", "glucose")


_HASH = "md5('3:' || event_id)"


@query(f"WITH {_P}, z AS (SELECT event_id, {_ZONE.format('y')} AS zone FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY {_HASH}, event_id) AS rn FROM z) SELECT event_id, zone FROM k WHERE rn <= 40")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return splits.balanced_sample(pairs(spark, d).select("event_id", rules.zone(F.col("y")).alias("zone")), "zone", "event_id", 120, 3, 3)


@query(f"WITH {_P} SELECT event_id, y FROM v ORDER BY {_HASH}, event_id LIMIT 200")
def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return splits.uniform_sample(pairs(spark, d), "event_id", 200, 3).select("event_id", "y")


_U = "((CAST('0x' || substr(md5('{0}:' || event_id), 1, 7) AS BIGINT) + 1) / 268436456.0)"


@query(f"WITH {_P}, t AS (SELECT unnest([10, 20, 40]) AS sigma) SELECT event_id, CAST(sigma AS INT) AS sigma, round(p + sigma * sqrt(-2 * ln({_U.format('5a')})) * cos(2 * pi() * {_U.format('5b')}), 6) AS noisy FROM v, t")
def noise_sweep(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d).withColumn("sigma", F.explode(F.array(*map(F.lit, (10, 20, 40)))))
    return df.select("event_id", "sigma", r6(F.col("p") + F.col("sigma") * splits.gaussian("event_id", 5)).alias("noisy"))


@query(f"WITH {_R} SELECT patient_id, {', '.join(f"round(avg(glucose) FILTER (WHERE channel = '{c}'), 6) AS {c}" for c in ROLES)} FROM r GROUP BY 1")
def mode_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(readings(spark, d).groupBy("patient_id").pivot("channel", list(ROLES)).agg(F.avg("glucose")), *ROLES)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS channel, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the windowed stream gives once all of the table has passed."""
    out = events.windowed(readings(spark, d), "timestamp", "channel", "glucose")
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "channel", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {_R}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) {_W} < 43200000000 THEN 0 ELSE 1 END AS new FROM r), s AS (SELECT *, sum(new) {_W} AS s FROM g)
SELECT patient_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY patient_id, s""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(readings(spark, d), "timestamp", "patient_id").select("patient_id", "n")


_HOT = "r0 AS (SELECT CASE WHEN event_id % 2 = 0 THEN '1' ELSE CAST(user_id AS VARCHAR) END AS patient_id, ts, value AS glucose, event_id, event_type AS channel FROM events)"


def _hot(spark: SparkSession, d: str) -> DataFrame:
    """Readings of which one patient has half."""
    return readings(spark, d).withColumn("patient_id", F.when(F.col("event_id") % 2 == 0, "1").otherwise(F.col("patient_id")))


@query(f"""WITH {_HOT}, l AS (SELECT *, epoch_us(ts) AS us FROM r0 WHERE channel = 'error'), b AS (SELECT *, epoch_us(ts) AS us FROM r0 WHERE channel = 'purchase'),
back AS (SELECT l.event_id, b.event_id AS bid, b.glucose, l.us - b.us AS dist FROM l ASOF JOIN b ON l.patient_id = b.patient_id AND l.us >= b.us),
ahead AS (SELECT l.event_id, b.event_id AS bid, b.glucose, b.us - l.us AS dist FROM l ASOF JOIN b ON l.patient_id = b.patient_id AND l.us <= b.us)
SELECT l.event_id, CASE WHEN ahead.dist IS NULL OR back.dist <= ahead.dist THEN back.bid ELSE ahead.bid END AS nearest, back.glucose AS step FROM l LEFT JOIN back USING (event_id) LEFT JOIN ahead USING (event_id)""")
def asof_hot_patient(spark: SparkSession, d: str) -> DataFrame:
    """As-of joins, nearest and backward, in blocks of time, as one patient has half of all rows."""
    r = _hot(spark, d)
    left, right = r.where("channel = 'error'"), r.where("channel = 'purchase'")
    near = temporal.asof(left, right, "patient_id", "timestamp", "glucose", "event_id", "event_id", block_rows=100).withColumn("nearest", F.col("matched.id")).drop("matched")
    both = temporal.asof(near, right, "patient_id", "timestamp", "glucose", "event_id", "event_id", "backward", block_rows=100)
    return both.select("event_id", "nearest", F.col("matched.value").alias("step"))


@query(f"""WITH r AS (SELECT * FROM r0), {_GAPS.replace("event_id % 5 < 2", "event_id % 5 < 3")}, j AS (SELECT p.*, {", ".join(f"{c}x.{c} AS {c}1, {c}y.{c} AS {c}2" for c in "uvs")} FROM p {" ".join(f"LEFT JOIN h {c}{t} ON {c}{t}.patient_id = p.patient_id AND {c}{t}.rn = p.{c}{e}" for c in "uvs" for t, e in (("x", "a"), ("y", "b")))})
SELECT event_id, CAST(rn AS BIGINT) AS rn, round({_filled("u")}, 6) AS u, round({_filled("v")}, 6) AS v, coalesce(s1, s2) AS s FROM j""".replace("WITH r AS", f"WITH {_HOT}, r AS"))
def fill_hot_patient(spark: SparkSession, d: str) -> DataFrame:
    """Gaps filled in blocks of time, as one patient has half of all rows."""
    i = F.col("event_id")
    df = _hot(spark, d).withColumns({"u": F.when(i % 5 >= 3, F.col("glucose")), "v": F.when(i % 7 >= 3, F.col("glucose") * 2), "s": F.when(i % 3 == 0, F.col("channel"))})
    made = features.fill_missing(df, "patient_id", ON, ["u", "v"], ["s"], block_rows=500, number_as="rn")
    return rounded(made.select("event_id", F.col("rn").cast("long").alias("rn"), "u", "v", "s"), "u", "v")
