"""Paired tests of models: by fold and by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, ml, splits
from .catalog import _P, _R, _SQL, _W, pairs, query, r6, readings, w

#: Twice the normal tail beyond |z|, by the series of the error function.
_TAIL = "(CASE WHEN abs({z}) > 6.5 THEN 0.0 WHEN {z} = 0 THEN 1.0 ELSE 1 - 2 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(abs({z})) - k * ln(2) - lgamma(k + 1)) / (2 * k + 1))) END)"
FOLDS = 6


def two_models(spark: SparkSession, d: str) -> DataFrame:
    """Errors of two forecasts six readings ahead: the value now, and the mean of the newest three."""
    v = readings(spark, d).withColumns({"y": F.lead("glucose", 6).over(w()), "a": F.col("glucose"), "b": F.avg("glucose").over(w().rowsBetween(-2, 0))}).where("y is not null")
    return v.select("patient_id", "event_id", "y", "a", "b")


_TWO = f"{_R}, m AS (SELECT patient_id, event_id, glucose AS a, avg(glucose) OVER (PARTITION BY patient_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS b, lead(glucose, 6) {_W} AS y FROM r), v AS (SELECT * FROM m WHERE y IS NOT NULL)"
_RANKED = "rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0"


@query(f"""WITH RECURSIVE {_TWO}, i AS (SELECT patient_id, (row_number() OVER (ORDER BY patient_id) - 1) % {FOLDS} AS fold FROM (SELECT DISTINCT patient_id FROM r)),
f AS (SELECT fold, round(sqrt(avg((y - a) * (y - a))), 2) - round(sqrt(avg((y - b) * (y - b))), 2) AS d0 FROM v JOIN i USING (patient_id) GROUP BY fold), e AS (SELECT round(d0, 2) AS d FROM f),
k AS (SELECT d, {_RANKED} AS r, count(*) OVER (PARTITION BY abs(d)) AS c FROM e WHERE d <> 0),
s AS (SELECT coalesce(sum(r) FILTER (WHERE d > 0), 0.0) AS up, coalesce(sum(r) FILTER (WHERE d < 0), 0.0) AS down, count(*) AS n, coalesce(sum(c * c - 1), 0.0) AS ties, (SELECT count(*) FROM e WHERE d = 0) AS zeros FROM k),
signings(i, total) AS (SELECT 0, 0 UNION ALL SELECT g.i + 1, g.total + t.x * (g.i + 1) FROM signings g, (SELECT unnest([0, 1]) AS x) t WHERE g.i < (SELECT n FROM s)),
x AS (SELECT least(1.0, 2.0 * count(*) FILTER (WHERE total <= least(up, down)) / count(*)) AS p FROM signings, s WHERE i = n),
t AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM e), h AS (SELECT t, df, atan(abs(t) / sqrt(df)) AS a FROM t)
SELECT CAST(up AS DOUBLE) AS w_plus, CAST(down AS DOUBLE) AS w_minus, round(CASE WHEN ties = 0 AND zeros = 0 THEN p ELSE {_TAIL.format(z="((least(up, down) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0))")} END, 5) AS wilcoxon_p,
round(t, 5) AS t, round(1 - 2 / pi() * (a + sin(a) * (cos(a) + 2.0 / 3 * cos(a) * cos(a) * cos(a))), 5) AS t_p FROM s, x, h""")
def fold_paired_tests(spark: SparkSession, d: str) -> DataFrame:
    """Two models' errors of six folds of patients, rounded to two places as they are reported, tested in pairs."""
    folds = splits.patients(readings(spark, d), "patient_id").select("patient_id", splits.strided_fold(F.col("place"), FOLDS).alias("fold"))
    rmse = lambda c: F.round(metrics.forecast_errors(F.col("y"), F.col(c))["rmse"], 2)
    per = two_models(spark, d).join(folds, "patient_id").groupBy("fold").agg(F.round(rmse("a") - rmse("b"), 2).alias("d"))
    ranks, t = metrics.signed_rank_p(per, "d"), metrics.paired_t(per, "d")
    return ranks.crossJoin(F.broadcast(t.select("t", F.col("p").alias("t_p")))).select("w_plus", "w_minus", F.round("p", 5).alias("wilcoxon_p"), F.round("t", 5).alias("t"), F.round("t_p", 5).alias("t_p"))


@query(f"""WITH {_TWO}, e AS (SELECT round(abs(y - a) - abs(y - b), 6) AS d FROM v), k AS (SELECT d, {_RANKED} AS r, count(*) OVER (PARTITION BY abs(d)) AS c FROM e WHERE d <> 0),
s AS (SELECT sum(r) FILTER (WHERE d > 0) AS up, sum(r) FILTER (WHERE d < 0) AS down, CAST(count(*) AS DOUBLE) AS n, sum(c * c - 1.0) AS ties FROM k)
SELECT CAST(n AS BIGINT) AS n, CAST(up AS DOUBLE) AS w_plus, CAST(down AS DOUBLE) AS w_minus, round({_TAIL.format(z="((least(up, down) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0))")}, 5) AS p,
(SELECT round(quantile_cont(abs(y - a), 0.5), 6) FROM v) AS median_a, (SELECT round(quantile_cont(abs(y - b), 0.5), 6) FROM v) AS median_b FROM s""")
def sample_paired_tests(spark: SparkSession, d: str) -> DataFrame:
    """The same models' absolute errors, tested event by event, with their medians."""
    e = two_models(spark, d).select(F.abs(F.col("y") - F.col("a")).alias("a"), F.abs(F.col("y") - F.col("b")).alias("b"))
    ranks = metrics.signed_rank_p(e.select(F.round(F.col("a") - F.col("b"), 6).alias("d")), "d")
    medians = metrics.quantiles(e, {"median_a": ("a", 0.5), "median_b": ("b", 0.5)})
    return ranks.crossJoin(F.broadcast(medians)).select("n", "w_plus", "w_minus", F.round("p", 5).alias("p"), r6("median_a").alias("median_a"), r6("median_b").alias("median_b"))


@query(f"""{_SQL["wilcoxon_stat"].split("SELECT CAST(sum")[0]}, s AS (SELECT CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS DOUBLE) AS w_minus, CAST(count(*) AS DOUBLE) AS n FROM k),
c AS (SELECT sum(m * m * m - m) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS m FROM e GROUP BY abs(d)))
SELECT w_plus, w_minus, CAST(n AS BIGINT) AS n, round({_TAIL.format(z="((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48))")}, 5) AS p FROM s, c""")
def wilcoxon_p(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.signed_rank_p(pairs(spark, d).select(F.round(F.col("y") - F.col("p"), 3).alias("d")), "d")
    return made.select("w_plus", "w_minus", "n", F.round("p", 5).alias("p"))


@query(f"""WITH {_P}, q AS (SELECT y - p AS d FROM v), t AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS DOUBLE) AS df, count(*) AS n, avg(d) AS mean FROM q)
SELECT n, round(mean, 6) AS mean, round({_TAIL.format(z="(t * (1 - 1 / (4 * df)) / sqrt(1 + t * t / (2 * df)))")}, 4) AS p FROM t""")
def paired_t_p(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.paired_t(pairs(spark, d).select((F.col("y") - F.col("p")).alias("d")), "d")
    return made.select("n", r6("mean").alias("mean"), F.round("p", 4).alias("p"))


@query()
def forest_paired_tests(spark: SparkSession, d: str) -> DataFrame:
    """A forest (10 trees of depth 5) against the value now: six folds of unseen patients, tested by fold and event by event."""
    df = readings(spark, d).select("patient_id", "timestamp", "event_id", "glucose")
    plan = ml.ForestPlan(["glucose"], horizon=6, predict_delta=True, trees=10, depth=5, on=("timestamp", "event_id"))
    made = ml.forecast_folds(df, plan, FOLDS, None, ("event_id",))
    rmse = lambda c: F.round(metrics.forecast_errors(F.col("y"), F.col(c))["rmse"], 2)
    per = made.groupBy("fold").agg(rmse("yhat").alias("forest"), rmse("anchor").alias("now")).withColumn("d", F.round(F.col("forest") - F.col("now"), 2))
    each = made.select(F.round(F.abs(F.col("y") - F.col("yhat")) - F.abs(F.col("y") - F.col("anchor")), 6).alias("d"))
    by_fold, t, by_event = metrics.signed_rank_p(per, "d"), metrics.paired_t(per, "d"), metrics.signed_rank_p(each, "d")
    means = per.agg(F.count("*").alias("folds"), r6(F.avg("forest")).alias("forest_rmse"), r6(F.avg("now")).alias("now_rmse"))
    out = means.crossJoin(F.broadcast(by_fold.select(F.round("p", 5).alias("fold_p")))).crossJoin(F.broadcast(t.select(F.round("p", 5).alias("fold_t_p"))))
    return out.crossJoin(F.broadcast(by_event.select("n", F.round("p", 5).alias("event_p"))))
