"""Forecast models on windows with Spark ML."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.scratch import delete, saved, scratch_dir
from . import features as fe
from . import metrics, splits

#: Weights of readings below 80 that are compared, and the alarm thresholds they are judged at.
LOW_WEIGHTS, ALARMS = (3.0, 6.0, 10.0), (70.0, 80.0)


@dataclass(frozen=True)
class ForestPlan:
    """How a forest forecasts; ``predict_delta`` learns the change from the window's last reading.

    Trees don't depend on the scale of a feature, so windows go in as they are.
    """

    features: list[str]
    target: str = "glucose"
    length: int = 12
    horizon: int = 1
    predict_delta: bool = False
    trees: int = 200
    depth: int = 20
    seed: int = 42
    by: str = "patient_id"
    on: tuple[str, ...] = ("timestamp",)

    @classmethod
    def of(cls, config: dict, horizon: int | None = None) -> ForestPlan:
        """From a configuration's ``model`` section; ``horizon`` overrides its default. Spark's trees have no least size of a split."""
        m = config["model"]
        forest = m.get("random_forest", {})
        used = m["engineered_features"] if m.get("use_engineered") else m["features"]
        return cls(list(used), length=m.get("sequence_length", 12), horizon=horizon or m.get("default_horizon", 1), predict_delta=m.get("predict_delta", False), trees=forest.get("n_estimators", 200), depth=forest.get("max_depth", 20), seed=forest.get("random_state", 42))


def forecast_windows(df: DataFrame, plan: ForestPlan) -> DataFrame:
    """Windows with their vector, and the label ``dy`` that the plan learns; those without a truth are dropped."""
    win = flat(fe.windows(df, plan.by, list(plan.on), plan.features, plan.target, plan.length, plan.horizon), plan.features)
    return win.withColumn("dy", F.col("y") - F.col("anchor") if plan.predict_delta else F.col("y").cast("double")).where("dy is not null")


def predict(model: RandomForestRegressionModel, win: DataFrame, plan: ForestPlan) -> DataFrame:
    """Windows with ``yhat``, a change added to the window's last reading where the plan learns changes."""
    return model.transform(win).withColumn("yhat", F.col("prediction") + F.col("anchor") if plan.predict_delta else F.col("prediction"))


def train(df: DataFrame, plan: ForestPlan, held_out: int = 2) -> tuple[RandomForestRegressionModel, DataFrame]:
    """The forest of all but the last ``held_out`` patients, and the metrics (one row) on these. Needs a patient more than that."""
    win = forecast_windows(df, plan).join(splits.patients(df, plan.by), plan.by)
    model = _fit(win.where(F.col("back") >= held_out), plan)
    return model, metrics.all_metrics(predict(model, win.where(F.col("back") < held_out), plan), "y", "yhat")


def _fit(win: DataFrame, plan: ForestPlan, weight: str | None = None) -> RandomForestRegressionModel:
    if win.isEmpty():
        raise ValueError("no windows to learn from: more patients or longer series are needed")
    return fit_forest(win, "dy", plan.trees, plan.depth, plan.seed, weight)


def train_from_config(df: DataFrame, config: dict, horizon: int | None = None) -> tuple[ForestPlan, RandomForestRegressionModel, DataFrame]:
    """Gaps filled, features engineered where the configuration asks for it, then :func:`train`."""
    plan = ForestPlan.of(config, horizon)
    numeric = [c for c in ("glucose", "carbs", "insulin", "activity") if c in df.columns]
    df = fe.fill_missing(df, plan.by, list(plan.on), numeric, [])
    if config["model"].get("use_engineered"):
        wanted = config["model"].get("feature_engineering", {})
        named = {"insulin_tau_min": "insulin_tau", "carbs_tau_min": "carbs_tau"}
        df = fe.engineer(df, plan.by, plan.on, **{named.get(k, k): v for k, v in wanted.items()}).withColumn("glucose_delta", F.col("glucose_trend"))  # the name that configurations use
    return plan, *train(df, plan)


def forecast_folds(df: DataFrame, plan: ForestPlan, folds: int = 6, width: int | None = 2, keep: tuple[str, ...] = (), at_once: int = 3) -> DataFrame:
    """Every window's forecast by a forest that did not see its patient: ``fold``, the patient, ``keep``, ``y, anchor, yhat``.

    Folds are ``width`` neighbouring patients each, or without a width every ``folds``-th patient. One saved table of windows
    serves all folds; ``at_once`` folds are fitted side by side, and each writes its forecasts.
    """
    spark = df.sparkSession
    place = splits.patients(df, plan.by)
    fold = splits.strided_fold(F.col("place"), folds) if width is None else splits.paired_fold(F.col("place"), width)
    win = saved(forecast_windows(df, plan).join(place, plan.by).withColumn("fold", fold.cast("int")).drop("place", "back"), "windows")
    out = scratch_dir(spark, "folds")
    sizes = {r.fold: r["count"] for r in win.groupBy("fold").count().collect() if r.fold < folds}

    def run(k: int) -> None:
        model = _fit(win.where(F.col("fold") != k), plan)
        made = predict(model, win.where(F.col("fold") == k), plan)
        made.select("fold", plan.by, *keep, "y", "anchor", "yhat").write.parquet(f"{out}/part={k}")

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(inheritable_thread_target(spark)(run), sorted(sizes)))
    delete(spark, win.saved_path)
    return spark.read.parquet(out).drop("part")


def cross_validate(df: DataFrame, plan: ForestPlan, folds: int = 6, width: int = 2) -> DataFrame:
    """``fold`` and the metrics of each fold of ``width`` patients; one forest a fold, fitted on all other patients."""
    t, p = F.col("y"), F.col("yhat")
    made = forecast_folds(df, plan, folds, width).where(t.isNotNull() & p.isNotNull())
    return made.groupBy("fold").agg(F.count("*").alias("n"), *[c.alias(n) for n, c in metrics.metric_columns(t, p).items()])


def weight_sweep(train_win: DataFrame, test_win: DataFrame, plan: ForestPlan, weights: tuple[float, ...] = LOW_WEIGHTS) -> DataFrame:
    """``weight, threshold``, the alarm counts and ratios of forecasts below each threshold, and ``rmse``, for each training weight of low readings."""
    found = []
    for weight in weights:
        model = _fit(train_win.withColumn("w", rules.low_weight(F.col("y"), weight)), plan, "w")
        each = predict(model, test_win, plan).withColumn("threshold", F.explode(F.array(*map(F.lit, ALARMS))))
        counts = metrics.binary(F.col("y") < ALARMS[0], F.col("yhat") < F.col("threshold"))
        error = F.col("y") - F.col("yhat")
        found.append(each.groupBy("threshold").agg(*[c.alias(n) for n, c in counts.items()], F.sqrt(F.avg(error * error)).alias("rmse")).withColumn("weight", F.lit(weight)))
    out = found[0]
    for each in found[1:]:
        out = out.unionByName(each)
    return out


def predict_newest(model: RandomForestRegressionModel, df: DataFrame, plan: ForestPlan) -> DataFrame:
    """One row a patient: ``yhat`` and ``zone`` of the forecast after its newest window, and ``sigma``, the trees' spread."""
    win = flat(fe.newest_windows(df, plan.by, list(plan.on), sorted({*plan.features, plan.target}), plan.length), plan.features)
    win = win.withColumn("anchor", F.element_at("x", -1)[plan.target].cast("double"))
    out = predict(model, win, plan).select(plan.by, "v", "yhat")
    return tree_spread(model, out).select(plan.by, "yhat", rules.zone(F.col("yhat")).alias("zone"), "sigma")


def save_model(model: RandomForestRegressionModel, plan: ForestPlan, scores: DataFrame, path: str) -> None:
    """The forest, its plan and its metrics below ``path``, over what was there."""
    model.write().overwrite().save(f"{path}/model")
    scores.sparkSession.createDataFrame([(json.dumps(asdict(plan)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")
    scores.write.mode("overwrite").json(f"{path}/metrics")


def load_model(spark: SparkSession, path: str) -> tuple[RandomForestRegressionModel, ForestPlan]:
    plan = json.loads(spark.read.text(f"{path}/plan").first()[0])
    return RandomForestRegressionModel.load(f"{path}/model"), ForestPlan(**plan | {"on": tuple(plan["on"])})


def flat(win: DataFrame, features: list[str]) -> DataFrame:
    """Windows with a time-major feature vector ``v``."""
    cells = F.flatten(F.transform("x", lambda c: F.array(*[c[f].cast("double") for f in features])))
    return win.withColumn("v", array_to_vector(cells))


def fit_forest(train: DataFrame, label: str, trees: int = 200, depth: int = 20, seed: int = 42, weight: str | None = None) -> RandomForestRegressionModel:
    rf = RandomForestRegressor(featuresCol="v", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all")
    return (rf.setWeightCol(weight) if weight else rf).fit(train)


def balanced_weight(df: DataFrame, cls: str) -> DataFrame:
    """Weight ``n / (classes * rows of the class)``; one count a class is broadcast."""
    counts = df.groupBy(cls).agg(F.count("*").alias("_c"))
    totals = counts.withColumns({"_n": F.sum("_c").over(Window.partitionBy(F.lit(1))), "_k": F.count("*").over(Window.partitionBy(F.lit(1)))})
    return df.join(F.broadcast(totals), cls).withColumn("w", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def fit_classifier(train: DataFrame, label: str, trees: int = 200, depth: int = 20, seed: int = 42):  # noqa: ANN201
    return RandomForestClassifier(featuresCol="v", labelCol=label, weightCol="w", numTrees=trees, maxDepth=depth, seed=seed).fit(train)


def tree_spread(model: RandomForestRegressionModel, df: DataFrame) -> DataFrame:
    """Mean and population deviation over the forest's trees."""
    out = df
    names = []
    for i, tree in enumerate(model.trees):
        names.append(f"_t{i}")
        out = tree.setPredictionCol(names[-1]).setFeaturesCol("v").transform(out)
    each = F.array(*names)
    mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / len(names)
    out = out.withColumn("prediction", mean)
    var = F.aggregate(each, F.lit(0.0), lambda s, x: s + (x - F.col("prediction")) * (x - F.col("prediction"))) / len(names)
    return out.withColumn("sigma", F.sqrt(var)).drop(*names)


def importance(model: RandomForestRegressionModel, features: list[str]) -> dict[str, float]:
    """Importance of each feature summed over the window, in percent."""
    v = model.featureImportances.toArray().reshape(-1, len(features)).sum(axis=0)
    return dict(zip(features, (100 * v / max(v.sum(), 1e-12)).tolist(), strict=True))
