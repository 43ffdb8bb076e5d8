"""Evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import HIGH, LOW, error_zone
from ..sources.scratch import saved

EPS = 1e-10


def forecast_errors(truth: Column, predicted: Column) -> dict[str, Column]:
    d = truth - predicted
    return {"rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d)), "mape": F.avg(F.abs(d / (truth + EPS))) * 100}


def metric_columns(t: Column, p: Column) -> dict[str, Column]:
    shares = {f"zone_{z.lower()}": F.avg((error_zone(t, p) == z).cast("double")) * 100 for z in "ABCDE"}
    return forecast_errors(t, p) | shares | {"zone_ab": shares["zone_a"] + shares["zone_b"]}


def all_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth), F.col(predicted)
    aggs = metric_columns(t, p)
    return df.where(t.isNotNull() & p.isNotNull()).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in aggs.items()])


def binary(truth: Column, alarm: Column) -> dict[str, Column]:
    """Counts and percentages of an alarm; a ratio without a denominator is null."""
    tp, fn, fp, tn = (F.count_if(x) for x in (truth & alarm, truth & ~alarm, ~truth & alarm, ~truth & ~alarm))
    pct = lambda a, b: F.try_divide(a * 100.0, b)
    return {"tp": tp, "fn": fn, "fp": fp, "tn": tn, "sensitivity": pct(tp, tp + fn), "specificity": pct(tn, tn + fp), "ppv": pct(tp, tp + fp), "f1": pct(2.0 * tp, 2 * tp + fp + fn)}


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: rows, sensitivity and PPV in percent, 0 without a denominator."""
    pairs = df.groupBy(truth, predicted).count()
    by_truth = pairs.groupBy(F.col(truth).alias("class")).agg(F.sum("count").alias("n"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("count"))).alias("hit"))
    by_call = pairs.groupBy(F.col(predicted).alias("class")).agg(F.sum("count").alias("called"))
    z = lambda c: F.coalesce(c, F.lit(0))
    out = by_truth.join(by_call, "class", "full")
    return out.select("class", z(F.col("n")).alias("n"), z(F.try_divide(z(F.col("hit")) * 100.0, F.col("n"))).alias("sensitivity"), z(F.try_divide(z(F.col("hit")) * 100.0, F.col("called"))).alias("ppv"))


def hypo_only(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    d, low = F.col(truth) - F.col(predicted), F.col(truth) < LOW
    return df.agg(F.count_if(low).alias("n_hypo"), F.sqrt(F.avg(F.when(low, d * d))).alias("hypo_rmse"), F.count_if(low & F.col(predicted).between(LOW, HIGH)).alias("missed_to_normal"))


#: Distinct values in one range of :func:`running`, about.
RANGE_ROWS = 200_000


def running(counts: DataFrame, value: str, n: str = "c", ranges: int | None = None) -> DataFrame:
    """Rows of distinct values with ``upto``, the sum of ``n`` over values no larger; no task sees them all.

    The counts are saved once. Values are dealt to ranges at approximate quantiles, more ranges for more values; sums run
    within a range and over the ranges' totals.
    """
    counts = saved(counts, "counts")
    ranges = ranges or max(1, -(-counts.count() // RANGE_ROWS))
    cuts = sorted(set(counts.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b < F.col(value))) if cuts else F.lit(0)
    counts = counts.withColumn("_r", place)
    totals = counts.groupBy("_r").agg(F.sum(n).alias("t")).select("_r", (F.sum("t").over(Window.orderBy("_r")) - F.col("t")).alias("_before"))
    within = F.sum(n).over(Window.partitionBy("_r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_within", within).join(F.broadcast(totals), "_r").withColumn("upto", F.col("_within") + F.col("_before")).drop("_r", "_within", "_before")


def order_statistic(df: DataFrame, score: str, alpha: float) -> DataFrame:
    """``q``: the score at sorted place ``1 + ceil(level * (n - 1))``, level ``min(1, ceil((n + 1)(1 - alpha)) / n)``.

    Scores are counted by value first; running counts are taken range by range.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("q")).agg(F.count("*").alias("c"))
    run = running(counts, "q")
    totals = run.agg(F.max("upto").alias("n"))
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"))
    return run.crossJoin(F.broadcast(totals)).where(F.col("upto") >= 1 + F.ceil(F.round(level * (F.col("n") - 1), 9))).agg(F.min("q").alias("q"), F.max("n").alias("n"))


def quantiles(df: DataFrame, of: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of exact interpolated quantiles: ``of`` maps names to a column and a share; null without values.

    Each column is counted by value once and searched range by range, so no buffer holds all values.
    """
    made = None
    for column in dict.fromkeys(c for c, _ in of.values()):
        run = running(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("q")).agg(F.count("*").alias("c")), "q")
        total = run.agg(F.max("upto").alias("n"))
        found = []
        for name, (c, share) in of.items():
            if c == column:
                at = F.lit(share) * (F.col("n") - 1)
                low, high = (F.min(F.when(F.col("upto") >= 1 + edge(F.round(at, 9)), F.col("q"))) for edge in (F.floor, F.ceil))
                found.append((low + (high - low) * F.max(at - F.floor(F.round(at, 9)))).alias(name))
        row = run.crossJoin(F.broadcast(total)).agg(*found)
        made = row if made is None else made.crossJoin(F.broadcast(row))
    return made.select(*of)


def group_quantiles(df: DataFrame, by: str, value: str, of: dict[str, float]) -> DataFrame:
    """A row for each group with exact interpolated quantiles, by name; groups without a value have none.

    Values are counted once (saved); a group with many distinct values is searched in ranges at its approximate
    quantiles, so that no buffer and no task holds a whole group.
    """
    counts = saved(df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")), "counts")
    most = counts.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    ranges = -(-most // RANGE_ROWS)
    if ranges > 1:
        cuts = counts.groupBy(F.col("g").alias("g2")).agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"))
        counts = counts.join(cuts, F.col("g").eqNullSafe(F.col("g2"))).withColumn("r", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("g2", "cuts")
    else:
        counts = counts.withColumn("r", F.lit(0))
    over = Window.partitionBy("g").orderBy("r")
    totals = counts.groupBy("g", "r").agg(F.sum("c").alias("t"))
    totals = totals.select(F.col("g").alias("g3"), F.col("r").alias("r3"), (F.sum("t").over(over) - F.col("t")).alias("before"), F.sum("t").over(Window.partitionBy("g")).alias("n"))
    within = F.sum("c").over(Window.partitionBy("g", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    run = counts.withColumn("upto", within).join(totals, F.col("g").eqNullSafe(F.col("g3")) & (F.col("r") == F.col("r3"))).withColumn("upto", F.col("upto") + F.col("before"))
    made = []
    for name, share in of.items():
        at = F.round(F.lit(share) * (F.col("n") - 1), 9)
        low, high = (F.min(F.when(F.col("upto") >= 1 + edge(at), F.col("v"))) for edge in (F.floor, F.ceil))
        made.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return run.groupBy(F.col("g").alias(by)).agg(*made)


def rank_metrics(topics: Column, expected: Column, k: int) -> dict[str, Column]:
    """Metrics of an ordered array of labels against the expected one."""
    place = F.array_position(topics, expected)
    gain = F.aggregate(F.zip_with(topics, F.sequence(F.lit(1), F.size(topics)), lambda t, i: F.when(t == expected, 1 / F.log2(i + 1.0)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.size(topics))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    hits = F.size(F.filter(topics, lambda t: t == expected))
    return {"hit1": (place == 1).cast("double"), "hitk": (place > 0).cast("double"), "mrr": F.when(place > 0, 1.0 / place).otherwise(0.0), "precision": hits / k, "ndcg": F.when(ideal > 0, gain / ideal).otherwise(0.0)}


def signed_rank(df: DataFrame, d: str) -> DataFrame:
    """Signed-rank sums of non-zero differences, average ranks for ties, over counts by absolute value."""
    counts = df.where((F.col(d) != 0) & F.col(d).isNotNull()).groupBy(F.abs(d).alias("a")).agg(F.count("*").alias("c"), F.count_if(F.col(d) > 0).alias("up"))
    ranked = running(counts, "a").withColumn("r", F.col("upto") - (F.col("c") - 1) / 2)
    return ranked.agg(F.sum(F.col("r") * F.col("up")).alias("w_plus"), F.sum(F.col("r") * (F.col("c") - F.col("up"))).alias("w_minus"), F.sum("c").alias("n"))


def paired_t(df: DataFrame, d: str) -> DataFrame:
    """``n``, mean, ``t`` and its two-sided ``p`` of paired differences; null without two rows or without spread."""
    made = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d))).alias("t"))
    return made.withColumn("p", student_tail(F.col("t"), F.col("n") - 1))


def normal_tail(z: Column) -> Column:
    """Twice the upper tail of the standard normal beyond ``|z|`` (a fixed rational approximation of erfc, error below 2e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return t * F.exp(poly - x * x)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of positive numbers: Stirling's series beyond 8, reached by the recurrence."""
    y = x + 8
    up = F.log(x)
    for i in range(1, 8):
        up = up + F.log(x + i)
    r = 1 / y
    series = r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r * (1 / 1680 - r * r / 1188))))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - up


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 200) -> Column:
    """The regularised incomplete beta function, by its continued fraction (evaluated from the front, after Lentz).

    It converges fast for ``x`` below ``(a + 1) / (a + b + 2)``; above, the mirrored function is used.
    """
    flip = x > (a + 1) / (a + b + 2)
    made = F.struct(F.when(flip, 1 - x).otherwise(x).alias("x"), F.when(flip, b).otherwise(a).alias("a"), F.when(flip, a).otherwise(b).alias("b"))
    tiny = 1e-300
    keep = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def of(q: Column) -> Column:
        x, a, b = q["x"], q["a"], q["b"]

        def step(s: Column, m: Column) -> Column:
            k = F.floor(m / 2).cast("double")
            even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
            odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
            c = F.when(m % 2 == 0, even).otherwise(odd)
            # one struct in, one out; the parts are made in turn so that none is computed twice
            return F.transform(F.array(F.struct(keep(1 + c * s["d"]).alias("u"), keep(1 + c / s["c"]).alias("v"))), lambda y: F.struct((1 / y["u"]).alias("d"), y["v"].alias("c"), (s["f"] * y["v"] / y["u"]).alias("f")))[0]

        start = F.struct(F.lit(1.0).alias("d"), F.lit(1.0).alias("c"), F.lit(1.0).alias("f"))
        first = F.transform(F.array(F.struct((1 / keep(1 - (a + b) * x / (a + 1))).alias("d"))), lambda y: F.struct(y["d"].alias("d"), F.lit(1.0).alias("c"), y["d"].alias("f")))[0]
        fraction = F.aggregate(F.sequence(F.lit(2), F.lit(terms)), F.coalesce(first, start), step)["f"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
        return F.when(x <= 0, 0.0).otherwise(front * fraction / a)

    value = F.transform(F.array(made), of)[0]
    return F.when(flip, 1 - value).otherwise(value)


def student_tail(t: Column, df: Column, exact_to: int = 10_000) -> Column:
    """Twice the upper tail of Student's t beyond ``|t|``; beyond ``exact_to`` degrees by a normal transform (its error falls with their square)."""
    t, df = t.cast("double"), df.cast("double")
    beta = incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))
    near = normal_tail(t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df)))
    return F.when((df > 0) & t.isNotNull(), F.when(df <= exact_to, beta).otherwise(near))


def exact_signed_rank(w: Column, n: Column, most: int = 50) -> Column:
    """Twice the share of the ``2**n`` signings whose positive ranks sum to ``w`` or less, 1 at most; null beyond ``most``.

    The number of signings for each sum is built rank by rank (exact in doubles up to 50 ranks).
    """
    ways = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")),
        F.array(F.lit(1.0)),
        lambda held, i: F.zip_with(F.concat(held, F.array_repeat(F.lit(0.0), i)), F.concat(F.array_repeat(F.lit(0.0), i), held), lambda x, y: x + y),
    )
    below = F.aggregate(F.slice(ways, 1, F.floor(w).cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    return F.when(n == 0, 1.0).when(n <= most, F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n)))


def signed_rank_p(df: DataFrame, d: str) -> DataFrame:
    """The signed-rank sums of non-zero differences, their two-sided ``p`` and its ``method``.

    Exact for up to 50 differences of which none is zero and no two are equal in size; else by the normal approximation
    with tie correction. 1 if all differences are zero.
    """
    given = df.where(F.col(d).isNotNull())
    counts = given.where(F.col(d) != 0).groupBy(F.abs(d).alias("a")).agg(F.count("*").cast("double").alias("c"))
    ties = counts.agg(F.coalesce(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")), F.lit(0.0)).alias("ties"))
    ties = ties.crossJoin(F.broadcast(given.agg(F.count_if(F.col(d) == 0).alias("zeros"))))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    low = F.least("w_plus", "w_minus")
    exact = (F.col("n") <= 50) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    made = signed_rank(df, d).crossJoin(F.broadcast(ties))
    p = F.when(exact, exact_signed_rank(low, F.when(exact, F.col("n")).otherwise(0))).when(spread > 0, normal_tail((low - n * (n + 1) / 4) / spread)).otherwise(1.0)
    return made.select("w_plus", "w_minus", "n", p.alias("p"), F.when(exact, "exact").otherwise("normal").alias("method"))


def accuracy(df: DataFrame, truth: str, predicted: str, divergent: Column) -> DataFrame:
    """Share of right classes over all rows and over the divergent ones; 0 without rows."""
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.count_if(divergent).alias("n_divergent"), F.coalesce(F.avg(F.when(divergent, hit)), F.lit(0.0)).alias("divergent_accuracy"))


def interval(kind: str, predicted: Column, sigma: Column, q: Column, z: float = 1.645) -> tuple[Column, Column]:
    """Lower and upper ends: ``baseline`` z sigma, ``absolute`` q, ``normalised`` q sigma."""
    half = {"baseline": z * sigma, "absolute": q, "normalised": q * sigma}[kind]
    return predicted - half, predicted + half
