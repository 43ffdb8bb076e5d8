"""Per-patient features over one window order; every operator takes its key, order and value columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import free, neighbours

BLOCK = 1024


def order(by: str, *on: str):  # noqa: ANN201
    return Window.partitionBy(by).orderBy(*on)


def decays(df: DataFrame, by: str, on: list[str], specs: list[tuple[str, str, float]], step_minutes: float = 5.0) -> DataFrame:
    """``out[t] = value[t] + exp(-step / tau) * out[t - 1]`` along each patient's rows, for each ``(value, name, tau)``.

    Null counts as zero. A closed form inside blocks of 1024 rows keeps exponents small. What a block inherits is folded
    once per block, over as many earlier blocks as a double can still tell from nothing, and joined by block.
    """
    w = order(by, *on)
    count, block, i, *rest = free(df, "n", "block", "i", *[f"{x}{j}" for x in ("own", "carry") for j in range(len(specs))])
    own, carried = rest[: len(specs)], rest[len(specs) :]
    inside = Window.partitionBy(by, block).orderBy(*on).rowsBetween(Window.unboundedPreceding, 0)
    ks = [step_minutes / tau for *_, tau in specs]
    df = df.withColumn(count, F.row_number().over(w) - 1).withColumns({block: F.floor(F.col(count) / BLOCK), i: F.col(count) % BLOCK})
    df = df.withColumns({o: F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0)) * F.exp(F.col(i) * k)).over(inside) * F.exp(-F.col(i) * k) for o, (v, *_), k in zip(own, specs, ks, strict=True)})
    ends = df.groupBy(by, block).agg(*[F.max_by(o, i).alias(o) for o in own])

    def carry(o: str, k: float) -> Column:
        before = Window.partitionBy(by).orderBy(block).rowsBetween(-math.ceil(745 / (k * BLOCK)), -1)
        return F.aggregate(F.collect_list(o).over(before), F.lit(0.0), lambda s, e: s * math.exp(-k * BLOCK) + e)

    ends = ends.select(by, block, *[carry(o, k).alias(c) for o, c, k in zip(own, carried, ks, strict=True)])
    out = df.join(ends, [by, block], "left")
    made = {name: F.col(o) + F.coalesce(c, F.lit(0.0)) * F.exp(-(F.col(i) + 1) * k) for o, c, (_, name, _), k in zip(own, carried, specs, ks, strict=True)}
    return out.withColumns(made).drop(count, block, i, *own, *carried)


def decay_accumulate(df: DataFrame, by: str, on: list[str], value: str, name: str, tau_minutes: float = 240.0, step_minutes: float = 5.0) -> DataFrame:
    """One decaying sum (:func:`decays`)."""
    return decays(df, by, on, [(value, name, tau_minutes)], step_minutes)


def engineer(df: DataFrame, by: str = "patient_id", on: tuple[str, ...] = ("timestamp",), insulin_tau: float = 240.0, carbs_tau: float = 180.0, trend_steps: int = 3, step_minutes: float = 5.0) -> DataFrame:
    """Adds ``iob, cob, glucose_trend, hour_sin, hour_cos``; insulin is ``bolus_dose`` where the table has it, else ``insulin``.

    Rows are dealt by patient once; only a row per 1024 readings is shuffled besides.
    """
    dose = "bolus_dose" if "bolus_dose" in df.columns else "insulin"
    angle = day_angle(F.col(on[0]))
    df = df.withColumn("glucose_trend", lag_delta(F.col("glucose"), trend_steps, order(by, *on)))
    df = decays(df, by, list(on), [(dose, "iob", insulin_tau), ("carbs", "cob", carbs_tau)], step_minutes)
    return df.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)})


def lag_delta(value: Column, steps: int, w) -> Column:  # noqa: ANN001
    return F.coalesce(value - F.lag(value, steps).over(w), F.lit(0.0))


def day_angle(ts: Column) -> Column:
    return 2 * math.pi * (F.hour(ts) + F.minute(ts) / 60) / 24


def minutes_since(ts: Column, w) -> Column:  # noqa: ANN001
    return (F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w)) / 6e7


def interpolate(df: DataFrame, by: str, on: list[str], value: str, name: str, block_rows: int | None = None) -> DataFrame:
    """Linear by position between present values of a patient, the nearest one at the ends.

    A patient too large for a task is worked on in blocks (:mod:`blocks`; ``block_rows`` sets their size).
    """
    made, rn, names = neighbours(df, by, on, {"v": F.col(value)}, block_rows)
    p, q = names["v"]
    share = (F.col(rn) - F.col(f"{p}.rn")) / F.nullif(F.col(f"{q}.rn") - F.col(f"{p}.rn"), F.lit(0))
    between = F.col(f"{p}.v") + (F.col(f"{q}.v") - F.col(f"{p}.v")) * share
    return made.withColumn(name, F.coalesce(F.col(value), between, F.col(f"{p}.v"), F.col(f"{q}.v"))).drop(rn, p, q)


def windows(df: DataFrame, by: str, on: list[str], features: list[str], target: str, length: int = 12, horizon: int = 1) -> DataFrame:
    """One row per sliding window: ``x`` (array of structs), ``y`` at the horizon, ``anchor`` at the window's end."""
    if length < 1 or horizon < 1:
        raise ValueError("length and horizon must be at least 1")
    w = order(by, *on)
    rn, left = free(df, "rn", "left")
    df = df.withColumns({"x": F.collect_list(F.struct(*features)).over(w.rowsBetween(1 - length, 0)), "y": F.lead(target, horizon).over(w), "anchor": F.col(target), rn: F.row_number().over(w), left: F.lead(F.lit(1), horizon).over(w)})
    return df.where((F.col(rn) >= length) & F.col(left).isNotNull()).drop(rn, left)


def pooled_scaler(win: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean and population deviation of each feature over all cells of all windows; no spread scales by one."""
    cells = win.select(F.explode("x").alias("c"))
    aggs = []
    for f in features:
        aggs += [F.avg(f"c.{f}").alias(f"{f}_mean"), F.coalesce(F.nullif(F.stddev_pop(f"c.{f}"), F.lit(0.0)), F.lit(1.0)).alias(f"{f}_scale")]
    return cells.agg(*aggs)


def every_nth(df: DataFrame, by: str, on: list[str], step: int) -> DataFrame:
    (rn,) = free(df, "rn")
    return df.withColumn(rn, F.row_number().over(order(by, *on))).where((F.col(rn) - 1) % step == 0).drop(rn)


def first_n(df: DataFrame, by: str, on: list[str], n: int, last: bool = False) -> DataFrame:
    keys = [F.desc(c) if last else F.asc(c) for c in on]
    (rn,) = free(df, "rn")
    return df.withColumn(rn, F.row_number().over(Window.partitionBy(by).orderBy(*keys))).where(F.col(rn) <= n).drop(rn)


def greedy_thin(df: DataFrame, by: str, index: str, gap: int) -> DataFrame:
    """Of each patient's indices the first, then each that lies ``gap`` or more after the last kept; null indices go.

    Rows stream through in order, so that a patient of any size needs one remembered index.
    """
    rows = df.select(by, F.col(index).cast("long").alias(index)).where(F.col(index).isNotNull())

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), None
        for batch in batches:
            kept = []
            for i, (patient, x) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if patient != now:
                    now, last = patient, None
                if last is None or x - last >= gap:
                    last = x
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int32()))

    return rows.repartition(by).sortWithinPartitions(by, index).mapInArrow(thin, rows.schema)


def fill_missing(df: DataFrame, by: str, on: list[str], numeric: list[str], other: list[str], block_rows: int | None = None, number_as: str | None = None) -> DataFrame:
    """No gaps: numeric columns linear by position, other columns the last value before, else the first after.

    Per patient; one sorted window serves all columns, within blocks where a patient is too large for a task (:mod:`blocks`;
    ``block_rows`` sets their size). A column that is null throughout a patient stays null there. ``number_as`` names a column for
    the row's number in its patient.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    made, rn, names = neighbours(df, by, on, {c: number(c) for c in numeric} | {c: F.col(c) for c in other}, block_rows)

    def between(c: str) -> Column:
        p, q = (F.col(x) for x in names[c])
        share = (F.col(rn) - p["rn"]) / F.nullif(q["rn"] - p["rn"], F.lit(0))
        return F.coalesce(p["v"] + (q["v"] - p["v"]) * share, p["v"], q["v"])

    filled = {c: between(c) for c in numeric} | {c: F.coalesce(*(F.col(x)["v"] for x in names[c])) for c in other}
    filled |= {number_as: F.col(rn)} if number_as else {}
    return made.withColumns(filled).drop(rn, *(x for pair in names.values() for x in pair))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    x = x.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_windows(win: DataFrame, features: list[str], target: str = "y") -> DataFrame:
    """Windows (:func:`windows`) whose target and cells are all finite."""
    return win.where(finite(F.col(target)) & F.forall("x", lambda c: finite_all([c[f] for f in features])))


def finite_all(cells: list[Column]) -> Column:
    ok = finite(cells[0])
    for c in cells[1:]:
        ok = ok & finite(c)
    return ok


def newest_windows(df: DataFrame, by: str, on: list[str], features: list[str], length: int = 12) -> DataFrame:
    """``x``, the last ``length`` rows of each patient in order as an array of structs; patients with fewer have none."""
    last = first_n(df, by, on, length, last=True)
    rows = last.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*on, *[F.col(f) for f in features if f not in on]))).alias("_x"))
    return rows.where(F.size("_x") == length).select(by, F.transform("_x", lambda s: F.struct(*[s[f].alias(f) for f in features])).alias("x"))


def apply_scaler(win: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    """Windows with every cell as ``(x - mean) / scale`` of a fitted one-row scaler (:func:`pooled_scaler`)."""
    scaled = F.transform("x", lambda c: F.struct(*[((c[f] - F.col(f"{f}_mean")) / F.col(f"{f}_scale")).alias(f) for f in features]))
    return win.crossJoin(F.broadcast(scaler)).withColumn("x", scaled).drop(*scaler.columns)  # one row is broadcast
