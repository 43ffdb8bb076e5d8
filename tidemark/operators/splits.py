"""Patient splits and deterministic samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patients(df: DataFrame, by: str) -> DataFrame:
    """Distinct patients with ``place`` (0 first) and ``back`` (0 last) in id order. One row a patient is ranked."""
    ids = df.select(by).where(F.col(by).isNotNull()).distinct()
    return ids.withColumns({"place": F.row_number().over(Window.orderBy(by)) - 1, "back": F.row_number().over(Window.orderBy(F.desc(by))) - 1})


def strided_fold(place: Column, folds: int) -> Column:
    return place % folds


def paired_fold(place: Column, width: int = 2) -> Column:
    return F.floor(place / width)


def three_way(back: Column, width: int = 2) -> Column:
    return F.when(back < width, "test").when(back < 2 * width, "calibration").otherwise("train")


def _hash(index: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(index).cast("string")))


def balanced_sample(df: DataFrame, cls: str, index: str, total: int, n_classes: int, seed: int = 0) -> DataFrame:
    """An equal share of each class, those of smallest seeded hash; the same rows whatever the partitions."""
    per = max(1, total // n_classes)
    w = Window.partitionBy(cls).orderBy(_hash(index, seed), index)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per).drop("_rn")


def uniform_sample(df: DataFrame, index: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, those of smallest seeded hash."""
    return df.withColumn("_h", _hash(index, seed)).orderBy("_h", index).limit(n).drop("_h")


def gaussian(index: str, seed: int) -> Column:
    """A standard normal number for each index, the same whatever the partitions (Box and Muller over two hashes)."""
    u = lambda s: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{s}:"), F.col(index).cast("string"))), 1, 7), 16, 10).cast("long") + 1) / 268436456.0
    return F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * math.pi * u("b"))


#: Rows of a leaf of the bootstrap's tree, about, and the most levels of the tree.
LEAF_ROWS, LEVELS = 4096, 16
#: Rows drawn at a time within a leaf.
DRAWN = 1 << 21


def bootstrap(df: DataFrame, value: str, index: str, draws: int, seed: int = 0) -> DataFrame:
    """``draw, mean, times`` of ``draws`` resamples with replacement, each of exactly as many rows as there are (``times``).

    Rows are leaves of a tree over the bits of a hash of ``index``. At each node a resample's rows are split by a binomial
    draw between its halves, given their sizes, and at the bottom they are drawn among a leaf's rows; so the counts are
    multinomial. Every node has a random generator of its own, so the same rows give the same resamples however they are
    partitioned, and a task needs only the sizes of the leaves (at most ``2 ** LEVELS`` numbers). Null values don't
    count; rows of equal index and value are rows of their own.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.col(index), F.lit(seed)).alias("h"), F.col(index).cast("string").alias("i"), F.col(value).cast("double").alias("v"))
    n = rows.count()
    levels = min(LEVELS, max(0, math.ceil(math.log2(max(n, 1) / LEAF_ROWS))))
    leaf = F.shiftrightunsigned("h", 64 - levels) if levels else F.lit(0).cast("long")
    rows = rows.withColumn("leaf", leaf)
    sizes = np.zeros(1 << levels, np.int64)
    for r in rows.groupBy("leaf").count().collect():
        sizes[r.leaf] = r["count"]
    before = np.r_[0, np.cumsum(sizes)]

    def of_leaf(number: int) -> np.ndarray:
        """How many rows each resample takes from a leaf."""
        counts, lo, hi = np.full(draws, n, np.int64), 0, 1 << levels
        for level in range(levels):
            mid = (lo + hi) // 2
            whole, low = before[hi] - before[lo], before[mid] - before[lo]
            part = np.random.Generator(np.random.Philox(key=[seed, (level << 32) + lo])).binomial(counts, low / whole if whole else 0.0)
            counts, lo, hi = (part, lo, mid) if number < mid else (counts - part, mid, hi)
        return counts

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, times = np.zeros(draws), np.zeros(draws, np.int64)

        def take(number: int, values: np.ndarray) -> None:
            counts = of_leaf(number)
            times[:] += counts
            rng = np.random.Generator(np.random.Philox(key=[seed, (1 << 48) + number]))
            step = max(1, DRAWN // len(values))
            for at in range(0, draws, step):
                k = counts[at : at + step]
                drawn = np.r_[0.0, np.cumsum(values[rng.integers(0, len(values), int(k.sum()))])]
                ends = np.cumsum(k)
                total[at : at + step] += drawn[ends] - drawn[ends - k]

        now, held = None, []
        for batch in batches:
            leaves, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.r_[0, np.flatnonzero(np.diff(leaves)) + 1, len(leaves)]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b > a:
                    if held and leaves[a] != now:
                        take(now, np.concatenate(held))
                        held = []
                    now = int(leaves[a])
                    held.append(values[a:b])
        if held:
            take(now, np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(total), pa.array(times)], names=["draw", "total", "times"])

    dealt = rows.repartition("leaf").sortWithinPartitions("leaf", "h", "i", "v").select("leaf", "v")
    made = dealt.mapInArrow(sums, "draw long, total double, times long").groupBy("draw").agg(F.sum("total").alias("total"), F.sum("times").alias("times"))
    return made.select("draw", F.try_divide("total", "times").alias("mean"), "times")


def poisson_bootstrap(df: DataFrame, value: str, index: str, draws: int, seed: int = 0) -> DataFrame:
    """``draw, mean`` of ``draws`` Poisson resamples (sizes vary; :func:`bootstrap` draws with replacement): each row counts a hashed Poisson(1) number of times in each draw.

    Each partition hands on one pair of sums for each draw. Null values don't count.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.col(index), F.lit(seed)).alias("h"), F.col(value).cast("double").alias("v"))
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        total, times = np.zeros(draws), np.zeros(draws)
        for batch in batches:
            h, v = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(h), 256):
                x = h[at : at + 256, None] + draw
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                n = np.searchsorted(steps, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, side="right")
                total += v[at : at + 256] @ n
                times += n.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(total), pa.array(times)], names=["draw", "total", "times"])

    made = rows.mapInArrow(sums, "draw long, total double, times double").groupBy("draw").agg(F.sum("total").alias("total"), F.sum("times").alias("times"))
    return made.select("draw", (F.col("total") / F.nullif("times", F.lit(0.0))).alias("mean"))
