"""The registered queries and their SQL. Readings are the ``events`` table: user, time, value, kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import contract, features, metrics, ml, splits, temporal, text, twin, vector

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
ON = ["timestamp", "event_id"]
_R = "r AS (SELECT CAST(user_id AS VARCHAR) AS patient_id, ts, value AS glucose, event_id, event_type AS channel FROM events)"
_W = "OVER (PARTITION BY patient_id ORDER BY ts, event_id)"


def query(sql: str | None = None, name: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import answers_catalog, embedding_catalog, features_catalog, retrieval_catalog, sql_catalog, statistics_catalog, streams_catalog  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("patient_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("glucose"), "event_id", F.col("event_type").alias("channel"), "props")


def w():  # noqa: ANN201
    return features.order("patient_id", *ON)


def r6(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places) + F.lit(0.0)  # no negative zero


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


def long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Persistence forecasts: the value six readings ahead against the value now."""
    last = features.order("patient_id", *map(F.asc_nulls_last, ON))  # as in SQL
    return readings(spark, d).withColumns({"y": F.lead("glucose", 6).over(last), "p": F.col("glucose")}).where("y is not null").select("patient_id", "event_id", "timestamp", "y", "p")


_P = f"{_R}, f AS (SELECT patient_id, event_id, ts, lead(glucose, 6) {_W} AS y, glucose AS p FROM r), v AS (SELECT * FROM f WHERE y IS NOT NULL)"
_ZONE = "CASE WHEN {0} < 70 THEN 'hypo' WHEN {0} > 180 THEN 'hyper' ELSE 'normal' END"
_CLARKE = "CASE WHEN (y < 70 AND p < 70) OR abs(y - p) <= 0.2 * y THEN 'A' WHEN y BETWEEN 70 AND 180 AND p BETWEEN 70 AND 180 THEN 'B' WHEN (y < 70 AND p > 180) OR (y > 180 AND p < 70) THEN 'C' WHEN p BETWEEN 70 AND 180 AND NOT (y BETWEEN 70 AND 180) THEN 'D' ELSE 'E' END"


@query(f"""WITH {_R}, x AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts, patient_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE glucose END AS glucose FROM r)
SELECT patient_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(glucose) AS BIGINT) AS null_glucose, round(sum(glucose), 4) AS total, 'none' AS meal_type FROM x WHERE ts IS NOT NULL GROUP BY patient_id""")
def contract_clean(spark: SparkSession, d: str) -> DataFrame:
    raw = readings(spark, d).select("patient_id", F.when(F.col("event_id") % 7 != 0, F.col("timestamp").cast("string")).alias("timestamp"), F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.col("glucose").cast("string")).alias("glucose"), *[F.lit("0").alias(c) for c in ("carbs", "insulin", "activity")])
    out = contract.validate(raw)
    return out.groupBy("patient_id").agg(F.count("*").alias("n"), F.count_if(F.col("glucose").isNull()).alias("null_glucose"), F.round(F.sum("glucose"), 4).alias("total"), F.max("meal_type").alias("meal_type"))


@query(f"WITH {_R} SELECT {_ZONE.format('glucose')} AS zone, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY 1")
def zone_profile(spark: SparkSession, d: str) -> DataFrame:
    z = readings(spark, d).groupBy(rules.zone(F.col("glucose")).alias("zone")).agg(F.count("*").alias("n"))
    return z.withColumn("share", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))


@query(f"""WITH {_P}, z AS (SELECT *, {_CLARKE} AS z FROM v)
SELECT CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(avg(abs((y - p) / (y + 1e-10))) * 100, 4) AS mape,
{", ".join(f"round(100.0 * avg(CAST(z = '{x}' AS INT)), 6) AS zone_{x.lower()}" for x in "ABCDE")}, round(100.0 * avg(CAST(z IN ('A', 'B') AS INT)), 6) AS zone_ab FROM z""")
def persistence_clarke(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.all_metrics(pairs(spark, d), "y", "p")
    return rounded(rounded(out, *[c for c in out.columns if c not in ("n", "mape")]), "mape", places=4)


@query(f"WITH {_R} SELECT CAST(hour(ts) AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS n, round(avg(glucose), 6) AS mean, round(stddev_samp(glucose), 6) AS sd FROM r GROUP BY 1")
def hourly_profile(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).groupBy(F.hour("timestamp").cast("long").alias("hour")).agg(F.count("*").alias("n"), r6(F.avg("glucose")).alias("mean"), r6(F.stddev_samp("glucose")).alias("sd"))


@query(f"""WITH {_R}, g AS (SELECT patient_id, (epoch_us(ts) - lag(epoch_us(ts)) {_W}) / 6e7 AS gap FROM r)
SELECT patient_id, round(quantile_cont(gap, 0.5), 6) AS median, round(quantile_cont(gap, 0.9), 6) AS p90, round(avg(gap), 6) AS mean FROM g GROUP BY 1""")
def gap_stats(spark: SparkSession, d: str) -> DataFrame:
    g = readings(spark, d).withColumn("gap", features.minutes_since(F.col("timestamp"), w()))
    return g.groupBy("patient_id").agg(r6(F.percentile("gap", F.lit(0.5))).alias("median"), r6(F.percentile("gap", F.lit(0.9))).alias("p90"), r6(F.avg("gap")).alias("mean"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, min({c}) AS lo, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS q2, round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS hi FROM lineitem" for c in _NUM))
def describe_numeric(spark: SparkSession, d: str) -> DataFrame:
    long_ = table(spark, d, "lineitem").select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("x")) for c in _NUM])).alias("s")).select("s.*")
    base = long_.groupBy("col").agg(F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    q = rounded(metrics.group_quantiles(long_, "col", "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75}), "q1", "q2", "q3")
    return base.join(q, "col").select("col", "n", "mean", "sd", "lo", "q1", "q2", "q3", "hi")


@query("SELECT " + ", ".join(f"round(corr({a}, {b}), 6) AS {a}_{b}" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]) + " FROM lineitem")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(*[r6(F.corr(a, b)).alias(f"{a}_{b}") for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]])


@query("SELECT event_type AS channel, round(100.0 * avg(CAST(value > 100 AS INT)), 6) AS share, max(value) AS hi, round(avg(value), 6) AS mean, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM events GROUP BY 1")
def sparsity(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).groupBy("channel").agg(r6(F.avg((F.col("glucose") > 100).cast("int")) * 100.0).alias("share"), F.max("glucose").alias("hi"), r6(F.avg("glucose")).alias("mean"), F.count_if(F.col("glucose").isNull()).alias("nulls"))


@query(f"""WITH {_R} SELECT event_id, round(coalesce(glucose - lag(glucose, 3) {_W}, 0), 6) + 0.0 AS d3, round(glucose - lag(glucose) {_W}, 6) + 0.0 AS d1,
round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) + 0.0 AS hour_cos FROM r""")
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    g, a = F.col("glucose"), features.day_angle(F.col("timestamp"))
    return readings(spark, d).select("event_id", r6(features.lag_delta(g, 3, w())).alias("d3"), r6(g - F.lag(g).over(w())).alias("d1"), r6(F.sin(a)).alias("hour_sin"), r6(F.cos(a)).alias("hour_cos"))


def _decay(name: str, tau: float) -> None:
    sql = f"WITH {_R}, n AS (SELECT *, row_number() {_W} - 1 AS n FROM r) SELECT event_id, round(sum(glucose * exp(n * {5 / tau!r})) {_W} * exp(-n * {5 / tau!r}), 5) AS {name} FROM n"

    @query(sql, f"decay_{name}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return features.decay_accumulate(readings(spark, d), "patient_id", ON, "glucose", name, tau).select("event_id", F.round(name, 5).alias(name))


_decay("iob", 240.0)
_decay("cob", 180.0)


@query(f"""WITH {_R}, h AS (SELECT event_id, patient_id, row_number() {_W} AS rn, CASE WHEN event_id % 5 < 2 THEN NULL ELSE glucose END AS v FROM r),
p AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN rn END) OVER (PARTITION BY patient_id ORDER BY rn) AS a, min(CASE WHEN v IS NOT NULL THEN rn END) OVER (PARTITION BY patient_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM h)
SELECT p.event_id, round(coalesce(p.v, x.v + (y.v - x.v) * (p.rn - p.a) / nullif(p.b - p.a, 0), x.v, y.v), 6) AS filled
FROM p LEFT JOIN h x ON x.patient_id = p.patient_id AND x.rn = p.a LEFT JOIN h y ON y.patient_id = p.patient_id AND y.rn = p.b""")
def interpolate_positional(spark: SparkSession, d: str) -> DataFrame:
    df = readings(spark, d).withColumn("v", F.when(F.col("event_id") % 5 >= 2, F.col("glucose")))
    return features.interpolate(df, "patient_id", ON, "v", "filled").select("event_id", r6("filled").alias("filled"))


def _win(spark: SparkSession, d: str) -> DataFrame:
    df = readings(spark, d).withColumn("delta", features.lag_delta(F.col("glucose"), 3, w()))
    return features.windows(df, "patient_id", ON, ["glucose", "delta"], "glucose", 12, 6)


_WIN = f"{_R}, c AS (SELECT *, coalesce(glucose - lag(glucose, 3) {_W}, 0) AS delta, row_number() {_W} AS rn, lead(glucose, 6) {_W} AS y, lead(1, 6) {_W} AS more FROM r)"


@query(f"""WITH {_WIN}, s AS (SELECT event_id, y, glucose AS anchor, rn, more, sum(glucose) OVER (PARTITION BY patient_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS total, lag(glucose, 11) {_W} AS first FROM c)
SELECT event_id, y, anchor, round(total, 6) AS total, first, CAST(12 AS BIGINT) AS n FROM s WHERE rn >= 12 AND more IS NOT NULL""")
def windows_l12_h6(spark: SparkSession, d: str) -> DataFrame:
    return _win(spark, d).select("event_id", "y", "anchor", r6(F.aggregate("x", F.lit(0.0), lambda s, c: s + c["glucose"])).alias("total"), F.get("x", F.lit(0))["glucose"].alias("first"), F.size("x").cast("long").alias("n"))


@query(f"""WITH {_WIN}, a AS (SELECT patient_id, rn FROM c WHERE rn >= 12 AND more IS NOT NULL), m AS (SELECT c.glucose, c.delta FROM a JOIN c ON c.patient_id = a.patient_id AND c.rn BETWEEN a.rn - 11 AND a.rn)
SELECT round(avg(glucose), 5) AS glucose_mean, round(stddev_pop(glucose), 5) AS glucose_scale, round(avg(delta), 5) AS delta_mean, round(stddev_pop(delta), 5) AS delta_scale FROM m""")
def scale_pooled(spark: SparkSession, d: str) -> DataFrame:
    out = features.pooled_scaler(_win(spark, d), ["glucose", "delta"])
    return rounded(out, *out.columns, places=5)


@query(f"WITH {_R}, n AS (SELECT event_id, row_number() {_W} AS rn FROM r) SELECT event_id FROM n WHERE (rn - 1) % 48 = 0")
def thin_every_n(spark: SparkSession, d: str) -> DataFrame:
    return features.every_nth(readings(spark, d), "patient_id", ON, 48).select("event_id")


@query(f"WITH {_R}, n AS (SELECT event_id, row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, event_id DESC) AS rn FROM r) SELECT event_id FROM n WHERE rn <= 12")
def last_n_per_user(spark: SparkSession, d: str) -> DataFrame:
    return features.first_n(readings(spark, d), "patient_id", ON, 12, last=True).select("event_id")


@query(f"WITH {_R}, n AS (SELECT event_id, row_number() {_W} AS rn FROM r) SELECT event_id FROM n WHERE rn <= 12")
def first_n_per_user(spark: SparkSession, d: str) -> DataFrame:
    return features.first_n(readings(spark, d), "patient_id", ON, 12).select("event_id")


_TOL = 60 * 60 * 1_000_000
_NEAREST = f"""{_R}, l AS (SELECT *, epoch_us(ts) AS us FROM r WHERE channel = 'error'), b AS (SELECT *, epoch_us(ts) AS us FROM r WHERE channel = 'view'),
back AS (SELECT l.event_id, b.event_id AS bid, l.us - b.us AS dist FROM l ASOF JOIN b ON l.patient_id = b.patient_id AND l.us >= b.us),
ahead AS (SELECT l.event_id, b.event_id AS bid, b.us - l.us AS dist FROM l ASOF JOIN b ON l.patient_id = b.patient_id AND l.us <= b.us),
m AS (SELECT l.event_id, l.glucose, CASE WHEN ahead.dist IS NULL OR back.dist <= ahead.dist THEN back.bid ELSE ahead.bid END AS bid, CASE WHEN ahead.dist IS NULL OR back.dist <= ahead.dist THEN back.dist ELSE ahead.dist END AS dist FROM l LEFT JOIN back USING (event_id) LEFT JOIN ahead USING (event_id)),
s AS (SELECT bid, sum(glucose) AS total FROM m WHERE dist <= {_TOL} GROUP BY 1)"""


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d)
    return temporal.align_sum(r.where("channel = 'view'"), r.where("channel = 'error'"), "patient_id", "timestamp", "glucose", "event_id", "event_id", _TOL)


@query(f"WITH {_NEAREST} SELECT b.event_id, round(coalesce(s.total, 0), 6) AS aligned_sum FROM b LEFT JOIN s ON s.bid = b.event_id")
def asof_nearest_sum(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d).select("event_id", r6("aligned_sum").alias("aligned_sum"))


@query(f"WITH {_NEAREST} SELECT b.event_id, CAST(s.total IS NOT NULL AS INT) AS present FROM b LEFT JOIN s ON s.bid = b.event_id")
def asof_presence(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d).select("event_id", "present")


@query(f"""WITH {_R}, l AS (SELECT * FROM r WHERE channel = 'view'), b AS (SELECT * FROM r WHERE channel = 'purchase')
SELECT l.event_id, round(coalesce(b.glucose, 0) * 5 / 60, 6) AS delivered FROM l ASOF LEFT JOIN b ON l.patient_id = b.patient_id AND l.ts >= b.ts""")
def step_fill(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d)
    out = temporal.asof(r.where("channel = 'view'"), r.where("channel = 'purchase'"), "patient_id", "timestamp", "glucose", "event_id", "event_id", "backward")
    return out.select("event_id", r6(F.coalesce("matched.value", F.lit(0.0)) * 5 / 60).alias("delivered"))


@query(f"""WITH {_R}, l AS (SELECT event_id, patient_id, epoch_us(ts) + 86400000000 AS us FROM r), b AS (SELECT event_id AS bid, patient_id, glucose, epoch_us(ts) AS us FROM r),
back AS (SELECT l.event_id, b.glucose, l.us - b.us AS dist FROM l ASOF JOIN b ON l.patient_id = b.patient_id AND l.us >= b.us),
ahead AS (SELECT l.event_id, b.glucose, b.us - l.us AS dist FROM l ASOF JOIN b ON l.patient_id = b.patient_id AND l.us <= b.us)
SELECT l.event_id, CASE WHEN ahead.dist IS NULL OR back.dist <= ahead.dist THEN CASE WHEN back.dist <= 10800000000 THEN back.glucose END WHEN ahead.dist <= 10800000000 THEN ahead.glucose END AS y
FROM l LEFT JOIN back USING (event_id) LEFT JOIN ahead USING (event_id)""")
def asof_future_target(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d)
    left = r.select("patient_id", "event_id", (F.col("timestamp") + F.expr("INTERVAL 1 DAY")).alias("timestamp"))
    return temporal.asof(left, r, "patient_id", "timestamp", "glucose", "event_id", "event_id", tolerance_us=3 * _TOL).select("event_id", F.col("matched.value").alias("y"))


@query("""WITH RECURSIVE i AS (SELECT user_id, event_id FROM events WHERE value > 50), k AS (SELECT user_id, min(event_id) AS event_id FROM i GROUP BY user_id
UNION ALL SELECT user_id, nxt FROM (SELECT k.user_id, (SELECT min(i.event_id) FROM i WHERE i.user_id = k.user_id AND i.event_id >= k.event_id + 500) AS nxt FROM k) t WHERE nxt IS NOT NULL)
SELECT CAST(user_id AS VARCHAR) AS patient_id, event_id FROM k""")
def greedy_thin(spark: SparkSession, d: str) -> DataFrame:
    return features.greedy_thin(readings(spark, d).where("glucose > 50"), "patient_id", "event_id", 500)


@query(f"""WITH {_R}, g AS (SELECT patient_id, event_id, glucose - lag(glucose) {_W} AS delta, (epoch_us(ts) - lag(epoch_us(ts)) {_W}) / 6e7 AS gap FROM r), m AS (SELECT patient_id, quantile_cont(gap, 0.5) AS med FROM g GROUP BY 1)
SELECT event_id, round(coalesce(delta, 0), 6) + 0.0 AS delta, round(coalesce(gap, med), 3) AS gap, round(coalesce(delta / nullif(gap, 0), 0), 3) + 0.0 AS slope FROM g JOIN m USING (patient_id)""")
def sparse_features(spark: SparkSession, d: str) -> DataFrame:
    g = readings(spark, d).withColumns({"delta": F.col("glucose") - F.lag("glucose").over(w()), "gap": features.minutes_since(F.col("timestamp"), w())})
    med = F.percentile("gap", F.lit(0.5)).over(Window.partitionBy("patient_id"))
    return g.select("event_id", r6(F.coalesce("delta", F.lit(0.0))).alias("delta"), F.round(F.coalesce("gap", med), 3).alias("gap"), (F.round(F.coalesce(F.col("delta") / F.nullif("gap", F.lit(0.0)), F.lit(0.0)), 3) + F.lit(0.0)).alias("slope"))


_RISK = "CASE WHEN y < 54 THEN 'critical_hypoglycemia' WHEN y < 70 THEN 'hypoglycemia' WHEN y > 250 THEN 'critical_hyperglycemia' WHEN y > 180 THEN 'hyperglycemia' ELSE 'normal' END"


@query(f"""WITH {_P}, a AS (SELECT event_id, y, p, y - p AS d, {_RISK} AS risk, 1 + event_id % 10 AS stress FROM v)
SELECT event_id, CASE WHEN abs(d) < 10 THEN 'stable' WHEN d > 0 THEN 'rising' ELSE 'falling' END AS trend, CASE WHEN abs(d) >= 30 THEN 'rapid' WHEN abs(d) >= 10 THEN 'moderate' ELSE 'slow' END AS pace, risk,
CASE WHEN risk LIKE 'critical%' THEN 'critical' WHEN risk LIKE 'hyp%' OR abs(d) >= 30 THEN 'high' WHEN stress >= 8 THEN 'medium' ELSE 'low' END AS urgency,
concat_ws(',', CASE WHEN risk LIKE '%hypo%' OR y - 20 < 70 THEN 'hypoglycemia' END, CASE WHEN risk LIKE '%hyper%' OR y + 20 > 180 THEN 'hyperglycemia' END, CASE WHEN risk = 'normal' THEN 'normal' END) AS conditions FROM a""")
def patient_state(spark: SparkSession, d: str) -> DataFrame:
    y, change = F.col("y"), F.col("y") - F.col("p")
    r, pace, stress = rules.risk(y), rules.pace(change), F.lit(1) + F.col("event_id") % 10
    return pairs(spark, d).select("event_id", rules.trend(change).alias("trend"), pace.alias("pace"), r.alias("risk"), rules.urgency(r, pace, stress).alias("urgency"), F.array_join(rules.conditions(r, y - 20, y + 20), ",").alias("conditions"))


@query(f"""WITH {_P}, c AS (SELECT *, {_ZONE.format("p")} AS now, {_ZONE.format("y")} AS later FROM v)
SELECT now, later, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN now <> later THEN 1 ELSE 0 END) AS BIGINT) AS divergent,
CAST(sum(CASE WHEN now = 'hypo' AND y >= 70 THEN 1 ELSE 0 END) AS BIGINT) AS warn_a, CAST(sum(CASE WHEN NOT (now = 'hypo' AND y >= 70) AND y - 30 < 70 AND y >= 70 THEN 1 ELSE 0 END) AS BIGINT) AS warn_b FROM c GROUP BY 1, 2""")
def early_warning(spark: SparkSession, d: str) -> DataFrame:
    now, later = rules.zone(F.col("p")), rules.zone(F.col("y"))
    df = pairs(spark, d).withColumns({"now": now, "later": later, "warn": rules.early_warning(now, F.col("y"), F.col("y") - 30)})
    return df.groupBy("now", "later").agg(F.count("*").alias("n"), F.count_if(F.col("now") != F.col("later")).alias("divergent"), F.count_if(F.col("warn") == "A").alias("warn_a"), F.count_if(F.col("warn") == "B").alias("warn_b"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).groupBy("patient_id").agg(F.round(F.avg("glucose") + 60, 3).alias("glucose"), (F.count("*") % 3).cast("double").alias("insulin"), (F.count("*") % 40).cast("double").alias("carbs"), (F.count("*") % 12).cast("double").alias("stress"), (F.count("*") % 50).cast("double").alias("activity"))


_STATES = "b AS (SELECT CAST(user_id AS VARCHAR) AS patient_id, least(400.0, greatest(40.0, round(avg(value) + 60, 3))) AS glucose, CAST(count(*) % 3 AS DOUBLE) AS insulin, CAST(count(*) % 40 AS DOUBLE) AS carbs, CAST(least(10, greatest(1, count(*) % 12)) AS DOUBLE) AS stress, CAST(count(*) % 50 AS DOUBLE) AS activity FROM events GROUP BY user_id)"
_PROJECT = "least(400.0, greatest(40.0, glucose + (-(insulin + {i}) * 50 + (carbs + {c}) * 3 + {s} * 2 - (activity + {a}) * 1.5) * {m} / 60))"
_GRID = [{"carbs": 45.0, "minutes": 120}, {"insulin": 1.0, "minutes": 60}, {"stress": -3.0, "minutes": 60}, {"activity": 30.0, "minutes": 90}]


@query("WITH " + _STATES + " " + " UNION ALL ".join(f"SELECT patient_id, {i} AS scenario, round({_PROJECT.format(i=s.get('insulin', 0.0), c=s.get('carbs', 0.0), s=f'least(10.0, greatest(1.0, stress + {s.get("stress", 0.0)}))', a=s.get('activity', 0.0), m=s['minutes'])}, 6) AS projected FROM b" for i, s in enumerate(_GRID)))
def whatif_grid(spark: SparkSession, d: str) -> DataFrame:
    return twin.what_if(_states(spark, d), _GRID).select("patient_id", "scenario", r6("projected").alias("projected"))


@query("WITH " + _STATES + f""", t AS (SELECT patient_id, i, 3.0 * (0.5 + i / 19.0) AS dose, {_PROJECT.format(i="3.0 * (0.5 + i / 19.0)", c="30.0", s="stress", a="0.0", m="120.0")} AS p FROM b, range(20) g(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY abs(p - 120), i) AS rn FROM t) SELECT patient_id, round(p, 6) AS dose_projected, CAST(i AS INT) AS i FROM k WHERE rn = 1""")
def dose_search(spark: SparkSession, d: str) -> DataFrame:
    out = twin.best_dose(_states(spark, d), F.lit(30.0))
    return out.select("patient_id", r6("dose_projected").alias("dose_projected"), F.round((F.col("dose") / 3 - 0.5) * 19).cast("int").alias("i"))


@query("WITH " + _STATES + """ SELECT patient_id, 'HIGH: high glucose' AS rule FROM b WHERE glucose > 180 UNION ALL SELECT patient_id, 'MEDIUM: stress' FROM b WHERE stress > 7
UNION ALL SELECT patient_id, 'MEDIUM: inactivity' FROM b WHERE activity < 15 UNION ALL SELECT patient_id, 'LOW: in range' FROM b WHERE glucose BETWEEN 70 AND 180 AND stress <= 6""")
def decision_rules(spark: SparkSession, d: str) -> DataFrame:
    return twin.decision_rules(twin.normalise_state(_states(spark, d))).select("patient_id", "rule")


@query("""SELECT event_id, round(CASE WHEN h >= 4 THEN 0 ELSE value * exp(-ln(2.0) / 2 * h) END, 6) AS iob, round(CASE WHEN h >= 3 THEN 0 ELSE greatest(0, value - value / 3 * h) END, 6) AS cob FROM (SELECT event_id, value, (event_id % 50) / 10.0 AS h FROM events)""")
def pk_decay_curves(spark: SparkSession, d: str) -> DataFrame:
    h, g = (F.col("event_id") % 50) / 10, F.col("glucose")
    return readings(spark, d).select("event_id", r6(rules.insulin_on_board(h, g)).alias("iob"), r6(rules.carbs_on_board(h, g)).alias("cob"))


@query("""SELECT CAST(user_id AS VARCHAR) AS patient_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS current_glucose, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS carbs_on_board, CAST(count(*) AS BIGINT) AS n_events FROM events GROUP BY user_id""")
def state_fold(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("channel")
    return twin.fold_events(readings(spark, d), "patient_id", ON, {"current_glucose": "glucose", "carbs_on_board": "glucose"}, {"current_glucose": c == "view", "carbs_on_board": c == "purchase"})


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def event_history_cap(spark: SparkSession, d: str) -> DataFrame:
    return twin.newest(table(spark, d, "conversations"), "conv_id", ["turn"], 3).select("conv_id", "turn")


_PLACE = "WITH i AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS patient_id FROM events), p AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS place, row_number() OVER (ORDER BY patient_id DESC) - 1 AS back FROM i)"


@query(_PLACE + " SELECT patient_id, CASE WHEN back < 2 THEN 'test' WHEN back < 4 THEN 'calibration' ELSE 'train' END AS part, CAST(place % 6 AS BIGINT) AS fold_strided, CAST(floor(place / 2) AS BIGINT) AS fold_paired, back < 2 AS holdout FROM p")
def patient_splits(spark: SparkSession, d: str) -> DataFrame:
    p = splits.patients(readings(spark, d), "patient_id")
    return p.select("patient_id", splits.three_way(F.col("back")).alias("part"), splits.strided_fold(F.col("place"), 6).cast("long").alias("fold_strided"), splits.paired_fold(F.col("place")).cast("long").alias("fold_paired"), (F.col("back") < 2).alias("holdout"))


_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, md5({_NORM.format('html')}) AS h FROM pages")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(text.normalize(F.col("html"))).alias("h"))


@query("""WITH k AS (SELECT doc_id, 'ext_' || regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') || '_' || substr(sha1(text), 1, 12) AS key, length(text) AS n FROM documents)
SELECT key, min(doc_id) AS doc_id FROM k WHERE n >= 120 AND key NOT IN (SELECT key FROM k WHERE doc_id % 10 = 0) AND doc_id % 10 <> 0 GROUP BY key""")
def doc_ids_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("key", text.doc_key(F.col("source"), F.col("text")))
    return text.import_new(docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0"), "key", "doc_id").select("key", "doc_id")


@query(r"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS v FROM documents), e AS (SELECT doc_id, v, unnest(range(1, len(v) + 1, 780)) AS st FROM s)
SELECT doc_id, CAST(st // 780 AS INT) AS pos, md5(array_to_string(v[st:st + 899], ' ')) AS h FROM e""")
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return text.word_chunks(table(spark, d, "documents"), "text").select("doc_id", "pos", F.md5("chunk").alias("h"))


@query()
def chunk_chars(spark: SparkSession, d: str) -> DataFrame:
    return text.char_chunks(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "pos", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("h"))


_TOK = "unnest(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


_COS = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), c AS (SELECT q.vec_id AS query_id, r.vec_id, r.x, q.label AS ql, r.label AS rl, round(list_cosine_similarity(q.x, r.x), 9) AS similarity FROM e q JOIN e r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM c)"


def _near(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.cosine_topk(e, e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", "embedding", k)


@query(_COS + " SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_near(spark, d, 5), "similarity")


_MMR = "".join(f""", s{n} AS (SELECT query_id, vec_id, x FROM (SELECT f.query_id, f.vec_id, f.x, row_number() OVER (PARTITION BY f.query_id ORDER BY round(0.5 * f.similarity - 0.5 * (SELECT max(round(list_cosine_similarity(f.x, p.x), 9)) FROM p{n - 1} p WHERE p.query_id = f.query_id), 9) DESC, f.rank) AS o FROM f WHERE NOT EXISTS (SELECT 1 FROM p{n - 1} p WHERE p.query_id = f.query_id AND p.vec_id = f.vec_id)) WHERE o = 1),
p{n} AS (SELECT query_id, vec_id, x, pick FROM p{n - 1} UNION ALL SELECT query_id, vec_id, x, {n} FROM s{n})""" for n in (2, 3, 4))


@query(_COS + ", f AS (SELECT * FROM k WHERE rank <= 12), p1 AS (SELECT query_id, vec_id, x, 1 AS pick FROM f WHERE rank = 1)" + _MMR + " SELECT query_id, vec_id, CAST(pick AS BIGINT) AS pick FROM p4")
def mmr_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.mmr_topk(e, e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", "embedding")


@query(_COS + """, t AS (SELECT query_id, rank, CAST(rl = ql AS INT) AS hit FROM k WHERE rank <= 5)
SELECT query_id, CAST(max(CASE WHEN rank = 1 THEN hit END) AS DOUBLE) AS hit1, CAST(max(hit) AS DOUBLE) AS hitk, round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0), 6) AS mrr, round(sum(hit) / 5.0, 6) AS precision, round(sum(hit / log2(rank + 1)) / sum(1 / log2(rank + 1)), 6) AS ndcg FROM t GROUP BY 1""")
def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    got = _near(spark, d, 5).join(labels, "vec_id").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"]).alias("topics"))
    got = got.join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    m = metrics.rank_metrics(F.col("topics"), F.col("label"), 5)
    return rounded(got.select("query_id", *[c.cast("double").alias(n) for n, c in m.items()]), *m)


@query(f"""WITH {_P}, c AS (SELECT {_ZONE.format("y")} AS t, {_ZONE.format("p")} AS c FROM v), k AS (SELECT unnest(['hypo', 'normal', 'hyper']) AS class)
SELECT class, CAST(sum(CAST(t = class AS INT)) AS BIGINT) AS n, round(coalesce(100.0 * sum(CAST(t = class AND c = class AS INT)) / nullif(sum(CAST(t = class AS INT)), 0), 0), 6) AS sensitivity, round(coalesce(100.0 * sum(CAST(t = class AND c = class AS INT)) / nullif(sum(CAST(c = class AS INT)), 0), 0), 6) AS ppv FROM k, c GROUP BY class""")
def confusion_multi(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d).select(rules.zone(F.col("y")).alias("t"), rules.zone(F.col("p")).alias("c"))
    return rounded(long(metrics.class_report(df, "t", "c"), "n"), "sensitivity", "ppv")


@query(f"""WITH {_P}, t AS (SELECT unnest([70, 75, 80, 85, 90, 95]) AS threshold), c AS (SELECT threshold, y < 70 AS pos, p < threshold AS alarm FROM v, t)
SELECT threshold, CAST(count(*) FILTER (WHERE pos AND alarm) AS BIGINT) AS tp, round(100.0 * count(*) FILTER (WHERE pos AND alarm) / nullif(count(*) FILTER (WHERE pos), 0), 6) AS sensitivity, round(100.0 * count(*) FILTER (WHERE NOT pos AND NOT alarm) / nullif(count(*) FILTER (WHERE NOT pos), 0), 6) AS specificity,
round(100.0 * count(*) FILTER (WHERE pos AND alarm) / nullif(count(*) FILTER (WHERE alarm), 0), 6) AS ppv FROM c GROUP BY 1""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in range(70, 100, 5)])))
    m = metrics.binary(F.col("y") < 70, F.col("p") < F.col("threshold"))
    return rounded(df.groupBy("threshold").agg(*[m[n].alias(n) for n in ("tp", "sensitivity", "specificity", "ppv")]), "sensitivity", "specificity", "ppv")


@query(f"WITH {_P} SELECT CAST(count(*) FILTER (WHERE y < 70) AS BIGINT) AS n_hypo, round(sqrt(avg((y - p) * (y - p)) FILTER (WHERE y < 70)), 6) AS hypo_rmse, CAST(count(*) FILTER (WHERE y < 70 AND p BETWEEN 70 AND 180) AS BIGINT) AS missed_to_normal FROM v")
def hypo_only(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.hypo_only(pairs(spark, d), "y", "p"), "hypo_rmse")


_Q = """s AS (SELECT abs(y - p) AS e, row_number() OVER (ORDER BY abs(y - p)) AS rn, count(*) OVER () AS n FROM v), q AS (SELECT e AS q, n FROM s WHERE rn = 1 + ceil(round(least(1.0, ceil((n + 1) * 0.9) / n) * (n - 1), 9)))"""


@query(f"WITH {_P}, {_Q} SELECT round(q, 6) AS q, CAST(n AS BIGINT) AS n FROM q")
def conformal_q(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.order_statistic(pairs(spark, d).select(F.abs(F.col("y") - F.col("p")).alias("e")), "e", 0.1), "q")


@query(f"WITH {_P}, {_Q} SELECT round(100.0 * avg(CAST(y BETWEEN p - q AND p + q AS INT)), 4) AS coverage, round(avg((p + q) - (p - q)), 6) AS width FROM v, q")
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    q = metrics.order_statistic(p.select(F.abs(F.col("y") - F.col("p")).alias("e")), "e", 0.1)
    lo, hi = F.col("p") - F.col("q"), F.col("p") + F.col("q")
    return p.crossJoin(F.broadcast(q.select("q"))).agg(F.round(F.avg(F.col("y").between(lo, hi).cast("int")) * 100.0, 4).alias("coverage"), r6(F.avg(hi - lo)).alias("width"))


@query(f"""WITH {_P}, i AS (SELECT patient_id, (row_number() OVER (ORDER BY patient_id) - 1) % 6 AS fold FROM (SELECT DISTINCT patient_id FROM r)), h AS (SELECT fold, sqrt(avg((y - p) * (y - p))) AS rmse FROM v JOIN i USING (patient_id) GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS folds, round(avg(rmse), 6) AS mean, round(stddev_pop(rmse), 6) AS sd_pop, round(stddev_samp(rmse), 6) AS sd_samp FROM h""")
def fold_mean_sd(spark: SparkSession, d: str) -> DataFrame:
    folds = splits.patients(readings(spark, d), "patient_id").select("patient_id", splits.strided_fold(F.col("place"), 6).alias("fold"))
    f = pairs(spark, d).join(folds, "patient_id").groupBy("fold").agg(metrics.forecast_errors(F.col("y"), F.col("p"))["rmse"].alias("rmse"))
    return f.agg(F.count("*").alias("folds"), r6(F.avg("rmse")).alias("mean"), r6(F.stddev_pop("rmse")).alias("sd_pop"), r6(F.stddev_samp("rmse")).alias("sd_samp"))


@query(f"WITH {_P} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(y - p), 6) AS mean, round(avg(y - p) / (stddev_samp(y - p) / sqrt(count(*))), 5) AS t FROM v")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.paired_t(pairs(spark, d).select((F.col("y") - F.col("p")).alias("d")), "d")
    return rounded(rounded(out.select("n", "mean", "t"), "mean"), "t", places=5)


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d).select("event_id", F.abs(F.col("y") - F.col("p")).alias("e"))
    b = splits.bootstrap(df, "e", "event_id", 5000)
    return b.agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))


@query()
def rf_regression(spark: SparkSession, d: str) -> DataFrame:
    win = ml.flat(_win(spark, d), ["glucose", "delta"]).withColumn("dy", F.col("y") - F.col("anchor"))
    test = F.pmod(F.xxhash64("patient_id"), F.lit(5)) == 0
    model = ml.fit_forest(win.where(~test), "dy", trees=10, depth=5)
    out = ml.tree_spread(model, win.where(test)).withColumn("yhat", F.col("anchor") + F.col("prediction"))
    return out.select("event_id", "y", F.round("yhat", 4).alias("yhat"), F.round("sigma", 4).alias("sigma"))


@query()
def rf_classifier_weighted(spark: SparkSession, d: str) -> DataFrame:
    win = ml.flat(_win(spark, d), ["glucose", "delta"]).withColumn("zone", rules.zone(F.col("y")))
    win = win.withColumn("cls", F.when(F.col("zone") == "hypo", 0.0).when(F.col("zone") == "hyper", 2.0).otherwise(1.0))
    test = F.pmod(F.xxhash64("patient_id"), F.lit(5)) == 0
    model = ml.fit_classifier(ml.balanced_weight(win.where(~test), "cls"), "cls", trees=10, depth=5)
    return model.transform(win.where(test)).select("event_id", "cls", "prediction")
