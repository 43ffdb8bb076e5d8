"""Exact distributions and quantiles against enumeration and closed forms."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics


def plain_t_tail(t, df):
    """The finite series for whole degrees of freedom."""
    a = math.atan(abs(t) / math.sqrt(df))
    c, s = math.cos(a), math.sin(a)
    odd = df % 2
    total = term = (c if odd else 1.0) if df > 1 else 0.0
    for k in range(1 + odd, df - 1, 2):
        term *= c * c * k / (k + 1)
        total += term
    return 1 - (2 / math.pi * (a + s * total) if odd else s * total)


def test_student_tail(spark):
    rows = [(t, df) for t in (0.0, 0.1, 1.0, -2.5, 7.0, 30.0) for df in (1, 2, 3, 5, 6, 30, 201, 5000, 60_000)]
    got = spark.createDataFrame(rows, "t double, df long").select("t", "df", metrics.student_tail(F.col("t"), F.col("df")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(plain_t_tail(r.t, r.df), rel=1e-5, abs=1e-10)
    none = spark.createDataFrame([(None, 5), (1.0, 0)], "t double, df long").select(metrics.student_tail(F.col("t"), F.col("df")).alias("p")).collect()
    assert [r.p for r in none] == [None, None]


def test_log_gamma(spark):
    rows = [(x,) for x in (0.5, 1.0, 2.5, 10.0, 500.5)]
    for r in spark.createDataFrame(rows, "x double").select("x", metrics.log_gamma(F.col("x")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.x), abs=1e-10)


def plain_signed_rank_p(d):
    ranks = sorted(map(abs, d))
    w = min(sum(ranks.index(abs(x)) + 1 for x in d if x > 0), sum(ranks.index(abs(x)) + 1 for x in d if x < 0))
    totals = [sum(i + 1 for i, x in enumerate(signs) if x) for signs in itertools.product((0, 1), repeat=len(d))]
    return min(1.0, 2 * sum(t <= w for t in totals) / len(totals))


def test_exact_signed_rank_p(spark):
    rng = random.Random(4)
    for n in (1, 2, 6, 9):
        d = [x * rng.choice((-1, 1)) for x in rng.sample(range(1, 100), n)]
        r = metrics.signed_rank_p(spark.createDataFrame([(float(x),) for x in d] + [(None,)], "d double"), "d").first()
        assert (r.n, r.method) == (n, "exact") and r.p == pytest.approx(plain_signed_rank_p(d))
    six = spark.createDataFrame([(float(x),) for x in range(1, 7)], "d double")
    assert metrics.signed_rank_p(six, "d").first().p == 0.03125


@pytest.mark.parametrize("d", [[1.0, -1.0, 3.0], [0.0, 1.0, 2.0], [float(x) for x in range(1, 60)]])
def test_ties_zeros_and_many_take_the_normal_approximation(spark, d):
    assert metrics.signed_rank_p(spark.createDataFrame([(x,) for x in d], "d double"), "d").first().method == "normal"


def test_fifty_ranks_are_exact(spark):
    d = [float(x) * (1 if x % 3 else -1) for x in range(1, 51)]
    ways = [1]
    for i in range(1, 51):
        ways = [a + b for a, b in zip(ways + [0] * i, [0] * i + ways, strict=True)]
    w = min(sum(x for x in d if x > 0), -sum(x for x in d if x < 0))
    r = metrics.signed_rank_p(spark.createDataFrame([(x,) for x in d], "d double"), "d").first()
    assert r.method == "exact" and r.p == pytest.approx(2 * sum(ways[: int(w) + 1]) / 2**50, rel=1e-12)


def test_paired_t(spark):
    d = [0.1, 0.3, -0.2, 0.5, 0.4, 0.2]
    r = metrics.paired_t(spark.createDataFrame([(x,) for x in d], "d double"), "d").first()
    mean = sum(d) / 6
    t = mean / (math.sqrt(sum((x - mean) ** 2 for x in d) / 5) / math.sqrt(6))
    assert r.t == pytest.approx(t) and r.p == pytest.approx(plain_t_tail(t, 5))
    for rows in ([], [(1.0,)], [(1.0,), (1.0,)]):
        assert metrics.paired_t(spark.createDataFrame(rows, "d double"), "d").first().p is None


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_quantiles(spark, n, monkeypatch):
    monkeypatch.setattr(metrics, "RANGE_ROWS", 13)
    rng = random.Random(n)
    x = sorted(rng.choice([rng.random(), 0.5]) for _ in range(n))
    df = spark.createDataFrame([(v, -v) for v in x] + [(None, None)], "x double, y double")
    got = metrics.quantiles(df, {"a": ("x", 0.25), "b": ("y", 0.5), "c": ("x", 1.0)}).first()

    def plain(v, p):
        at = p * (len(v) - 1)
        i = min(int(at), len(v) - 2) if len(v) > 1 else 0
        return v[i] + (v[min(i + 1, len(v) - 1)] - v[i]) * (at - i)

    expected = (plain(x, 0.25), plain(sorted(-v for v in x), 0.5), plain(x, 1.0)) if n else (None,) * 3
    assert tuple(got) == (pytest.approx(expected) if n else expected)


@pytest.mark.parametrize("most", [5, 10**6])
def test_group_quantiles(spark, most, monkeypatch):
    monkeypatch.setattr(metrics, "RANGE_ROWS", most)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.25, None])) for _ in range(300)] + [("one", 2.0), ("none", None)]
    got = {r.g: (r.q1, r.q2) for r in metrics.group_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", {"q1": 0.25, "q2": 0.5}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g in got:
        v = sorted(x for k, x in rows if k == g and x is not None)

        def plain(p, v=v):
            at = p * (len(v) - 1)
            i = int(at)
            return v[i] + (v[min(i + 1, len(v) - 1)] - v[i]) * (at - i)

        assert got[g] == pytest.approx((plain(0.25), plain(0.5)))
