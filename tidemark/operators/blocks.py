"""Patients of any size: their rows dealt to blocks of time, and what a block needs from the others carried over.

A window over a patient puts all its rows in one task. Where a patient has more rows than a task should sort, time is cut
into blocks that all patients share; windows then run within a patient's block, each block hands on a row of what it
ends and begins with, and a window over these few rows gives every block its neighbours' values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one patient in a task, about; and the most blocks.
BLOCK_ROWS, MAX_BLOCKS = 2_000_000, 256
#: Tables that Spark's statistics put below this size are not searched for large patients.
SMALL_BYTES = 256 << 20


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that ``df`` does not have."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def cuts(df: DataFrame, by: str, at: Column, rows: int | None = None) -> list[float]:
    """Times that cut the rows into blocks, if some patient has more than ``rows``; else none.

    ``rows`` given, the table is searched whatever its size. The cuts are quantiles of all rows' times, so a block has about
    ``rows`` rows of all patients together, or more where that takes over MAX_BLOCKS.
    """
    if rows is None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size < SMALL_BYTES:
            return []
    most = rows or BLOCK_ROWS
    per = df.groupBy(by).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    if not per.n or per.most <= most:
        return []
    n = min(MAX_BLOCKS, math.ceil(per.n / most))
    return sorted(set(df.select(at.cast("double").alias("t")).approxQuantile("t", [i / n for i in range(1, n)], 0.1 / n)))


def block_of(at: Column, cuts: list[float]) -> Column:
    """The number of a time's block; rows of equal time are in one, those without a time in the first."""
    time = at.cast("double")
    if not cuts:
        return F.lit(0)
    # how many cuts lie before the time, by halving steps over the sorted cuts
    n, ends = len(cuts), F.lit([float(c) for c in cuts])
    steps = F.lit([1 << i for i in reversed(range(n.bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= n) & (F.get(ends, F.least(a + s, F.lit(n)) - 1) < time), a + s).otherwise(a))
    return F.when(time.isNull(), 0).otherwise(place)


def neighbours(df: DataFrame, by: str, on: list[str], values: dict[str, Column], rows: int | None = None) -> tuple[DataFrame, str, dict[str, tuple[str, str]]]:
    """``df`` with each row's number in its patient, and for each value the nearest one that is not null before (or at) and
    after (or at) the row, as structs of ``rn, v``; their columns' names: the number's, and by value's name a pair.
    """
    block, rn, inner = free(df, "block", "rn", "inner")
    names = {k: tuple(free(df, f"p{i}", f"q{i}")) for i, k in enumerate(values)}
    at = cuts(df, by, F.col(on[0]), rows)
    w = Window.partitionBy(by, block).orderBy(*on) if at else Window.partitionBy(by).orderBy(*on)
    # what lies ahead is what lies behind in the reverse order: frames that end at the last row are computed anew for each row
    reverse = (Window.partitionBy(by, block) if at else Window.partitionBy(by)).orderBy(F.desc(inner))
    back, ahead = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (w, reverse))
    point = {k: F.when(v.isNotNull(), F.struct(F.col(inner).alias("rn"), v.alias("v"))) for k, v in values.items()}
    made = df.withColumn(block, block_of(F.col(on[0]), at)) if at else df
    made = made.withColumn(inner, F.row_number().over(w))
    scans = {names[k][i]: F.last(point[k], ignorenulls=True).over(o) for k in values for i, o in enumerate((back, ahead))}
    made = made.withColumns(scans)
    if not at:
        return made.withColumnRenamed(inner, rn), rn, names
    # of each block: its rows, and its last and first points as seen from its ends
    ends = made.groupBy(by, block).agg(F.max(inner).alias("n"), *[F.max_by(names[k][0], inner).alias(f"last{i}") for i, k in enumerate(values)], *[F.min_by(names[k][1], inner).alias(f"first{i}") for i, k in enumerate(values)])
    over = Window.partitionBy(by).orderBy(block)
    before, after = (x.rowsBetween(Window.unboundedPreceding, -1) for x in (over, Window.partitionBy(by).orderBy(F.desc(block))))
    ends = ends.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))
    shifted = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.rn") + F.col("shift")).alias("rn"), F.col(f"{c}.v").alias("v")))
    ends = ends.withColumns({c: shifted(c) for i in range(len(values)) for c in (f"last{i}", f"first{i}")})
    carried = ends.select(F.col(by).alias("_by"), F.col(block).alias("_block"), F.col("shift").alias("_shift"), *[F.last(f"last{i}", ignorenulls=True).over(before).alias(f"_last{i}") for i in range(len(values))], *[F.last(f"first{i}", ignorenulls=True).over(after).alias(f"_first{i}") for i in range(len(values))])
    joined = made.alias("m").join(carried.alias("c"), F.col(f"m.{by}").eqNullSafe(F.col("c._by")) & (F.col(f"m.{block}") == F.col("c._block")), "left")
    moved = lambda c: F.when(F.col(f"m.{c}").isNotNull(), F.struct((F.col(f"m.{c}.rn") + F.col("c._shift")).alias("rn"), F.col(f"m.{c}.v").alias("v")))
    out = [F.col(f"m.`{c}`") for c in df.columns] + [(F.col(f"m.{inner}") + F.col("c._shift")).alias(rn)]
    for i, k in enumerate(values):
        p, q = names[k]
        out += [F.coalesce(moved(p), F.col(f"c._last{i}")).alias(p), F.coalesce(moved(q), F.col(f"c._first{i}")).alias(q)]
    return joined.select(*out), rn, names
