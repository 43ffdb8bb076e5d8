"""As-of joins by key without a range join: union both sides, then look along one sorted window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import block_of, cuts


def asof(left: DataFrame, right: DataFrame, by: str, on: str, value: str, left_id: str, right_id: str, direction: str = "nearest", tolerance_us: int | None = None, name: str = "matched", block_rows: int | None = None) -> DataFrame:
    """Left rows with the matching right row as a struct ``name`` of ``id, value, us``, null without a match.

    ``nearest`` takes the closer neighbour, the earlier one on a tie; ``backward`` the last at or before. Among equal
    times the last right row by id counts backward, the first forward. The tolerance is inclusive. One shuffle by ``by``; where
    a patient has too many rows for one task, by ``by`` and a block of time (:mod:`blocks`; ``block_rows`` sets their size),
    and each block gets the last right row before it and the first one after it from a row per block.
    """
    us = F.unix_micros(F.col(on).cast("timestamp"))
    kind = dict(left.dtypes)
    rows = left.select(F.col(by).alias("_by"), us.alias("_us"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"), F.lit(None).cast(f"struct<id:{dict(right.dtypes)[right_id]},value:{dict(right.dtypes)[value]},us:bigint>").alias("_right"), F.lit(0).alias("_n"))
    other = right.select(F.col(by).cast(kind[by]).alias("_by"), us.alias("_us"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), F.struct(F.col(right_id).alias("id"), F.col(value).alias("value"), us.alias("us")).alias("_right"), F.col(right_id).cast("long").alias("_n"))
    every = rows.unionByName(other)
    at = cuts(every, "_by", F.col("_us"), block_rows)
    every = every.withColumn("_block", block_of(F.col("_us"), at))
    w = Window.partitionBy("_by", "_block") if at else Window.partitionBy("_by")
    is_left = F.col("_left").isNotNull()
    back = F.last("_right", ignorenulls=True).over(w.orderBy("_us", is_left, "_n").rowsBetween(Window.unboundedPreceding, 0))
    found = every.withColumn("_b", back)
    if direction == "nearest":
        found = found.withColumn("_f", F.last("_right", ignorenulls=True).over(w.orderBy(F.desc("_us"), is_left, F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)))
    found = found.where(is_left)
    if at:
        place = F.when(F.col("_right").isNotNull(), F.struct("_us", "_n"))
        ends = every.groupBy("_by", "_block").agg(F.max_by("_right", place).alias("l"), F.min_by("_right", place).alias("f"))
        over = Window.partitionBy("_by").orderBy("_block")
        ends = ends.select(F.col("_by").alias("_by2"), F.col("_block").alias("_block2"), F.last("l", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_b2"), F.last("f", ignorenulls=True).over(Window.partitionBy("_by").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)).alias("_f2"))
        found = found.join(ends, F.col("_by").eqNullSafe(F.col("_by2")) & (F.col("_block") == F.col("_block2")), "left").withColumn("_b", F.coalesce("_b", "_b2"))
        if direction == "nearest":
            found = found.withColumn("_f", F.coalesce("_f", "_f2"))
    pick = F.col("_b")
    if direction == "nearest":
        before, after = F.col("_us") - F.col("_b.us"), F.col("_f.us") - F.col("_us")
        pick = F.when(F.col("_f").isNull() | (before <= after), F.col("_b")).otherwise(F.col("_f"))
    found = found.withColumn("_m", pick)
    if tolerance_us is not None:
        found = found.withColumn("_m", F.when(F.abs(F.col("_m.us") - F.col("_us")) <= tolerance_us, F.col("_m")))
    return found.select("_left.*", F.col("_m").alias(name))


def align_sum(base: DataFrame, events: DataFrame, by: str, on: str, value: str, base_id: str, event_id: str, tolerance_us: int) -> DataFrame:
    """Base rows with ``aligned_sum`` and ``present``: each event goes to its nearest base row within the tolerance."""
    hit = asof(events, base, by, on, base_id, event_id, base_id, tolerance_us=tolerance_us)
    sums = hit.where("matched is not null").groupBy(F.col("matched.id").alias(base_id)).agg(F.sum(value).alias("aligned_sum"))
    out = base.join(sums, base_id, "left")
    return out.withColumns({"present": F.col("aligned_sum").isNotNull().cast("int"), "aligned_sum": F.coalesce("aligned_sum", F.lit(0.0))})


def assemble(events: DataFrame, base: str = "glucose_level", tolerance_us: int = 150_000_000, sums: tuple[str, ...] = ("meal", "bolus", "exercise"), marks: tuple[str, ...] = ("stressors", "sleep", "work", "illness"), step: str = "basal", step_minutes: float = 5.0) -> DataFrame:
    """Readings from channel events ``patient_id, channel, timestamp, value, event_id``.

    The time line is the base channel's positive values. Events of the summed and marked channels go to the nearest
    base row within the tolerance, all channels in one as-of join; the basal rate is the last one before.
    ``insulin`` is bolus plus what the basal rate delivers in a step.
    """
    line = events.where((F.col("channel") == base) & (F.col("value") > 0)).select("patient_id", "timestamp", "event_id", F.col("value").alias("glucose"))
    near = asof(events.where(F.col("channel").isin(*sums, *marks)), line, "patient_id", "timestamp", "event_id", "event_id", "event_id", tolerance_us=tolerance_us)
    made = near.where("matched is not null").groupBy(F.col("matched.id").alias("event_id")).agg(*[F.sum(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in sums], *[F.max((F.col("channel") == c).cast("int")).alias(c) for c in marks])
    rate = asof(line, events.where(F.col("channel") == step), "patient_id", "timestamp", "value", "event_id", "event_id", "backward")
    out = rate.join(made, "event_id", "left")
    total = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    basal = F.coalesce("matched.value", F.lit(0.0))
    meal, bolus, exercise = (total(c) for c in sums)
    flags = dict(zip(("stress", "sleep", "work", "illness"), (F.coalesce(c, F.lit(0)) for c in marks), strict=False))
    return out.select("patient_id", "timestamp", "event_id", "glucose", meal.alias("carbs"), (bolus + basal * step_minutes / 60).alias("insulin"), bolus.alias("bolus_dose"), basal.alias("basal_rate"), exercise.alias("activity"), *[v.alias(k) for k, v in flags.items()], F.when(meal > 0, "meal").otherwise("none").alias("meal_type"))


def asof_context(left: DataFrame, right: DataFrame, by: str, on: str, columns: list[str], left_id: str, right_id: str, tolerance_us: int) -> DataFrame:
    """Left rows with several columns of the nearest right row within the tolerance, null without one."""
    packed = right.select(by, on, right_id, F.struct(*columns).alias("_values"))
    found = asof(left, packed, by, on, "_values", left_id, right_id, tolerance_us=tolerance_us)
    return found.select(*left.columns, *[F.col(f"matched.value.{c}").alias(c) for c in columns])
