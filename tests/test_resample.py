"""Resamples as counts of cells: binomial numbers, multinomial draws, and intervals beside an exact bootstrap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.operators import agreement, bootstrap, resample


@pytest.mark.parametrize("n, p", [(10, 0.3), (10, 0.95), (500, 0.01), (60, 0.5), (4000, 0.4), (10**12, 3e-12), (10**12, 0.25)])
def test_binomial(spark, n, p):
    df = spark.range(40_000).select(resample.binomial(F.lit(n), F.lit(p), resample.hash_share("s", F.col("id"), "a"), resample.hash_share("s", F.col("id"), "b")).alias("w"))
    w = np.array([r.w for r in df.collect()])
    sd = np.sqrt(n * p * (1 - p))
    assert w.min() >= 0 and w.max() <= n
    assert abs(w.mean() - n * p) < 5 * sd / 200 and abs(w.std() / sd - 1) < 0.03
    plain = np.random.default_rng(1).binomial(n, p, 40_000)
    for q in (0.025, 0.5, 0.975):
        at = np.quantile(plain, q)
        assert abs((w <= at).mean() - (plain <= at).mean()) < 0.015


def test_binomial_at_the_ends(spark):
    u = (F.lit(0.999999), F.lit(0.5))
    r = spark.range(1).select(*(resample.binomial(F.lit(n), F.lit(p), *u).alias(str(k)) for k, (n, p) in enumerate([(0, 0.5), (7, 0.0), (7, 1.0), (1, 0.5)]))).first()
    assert list(r) == [0, 0, 7, 1]


def test_draws_have_as_many_rows_as_the_group(spark):
    rows = [("a", 1)] * 3 + [("a", 2)] + [("b", v) for v in range(40)] * 25 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(3)
    draws = resample.cell_draws(df, ["g"], ["v"], n=300)
    assert {(r.g, r.n) for r in draws.groupBy("g", "draw").agg(F.sum("w").alias("n")).collect()} == {("a", 4), ("b", 1000)}
    means = {(r.g, r.v): (r.m, r.s) for r in draws.groupBy("g", "v").agg((F.sum("w") / 300).alias("m"), (F.sum(F.col("w") * F.col("w")) / 300).alias("s")).collect()}
    assert abs(means["a", 2][0] - 1) < 0.2 and abs(means["a", 2][1] - 1 - 0.75) < 0.3  # a cell of one row: mean 1, variance 3/4
    assert all(abs(m - 25) < 1.5 for (g, _), (m, _) in means.items() if g == "b")
    again = resample.cell_draws(df.repartition(7), ["g"], ["v"], n=300)
    assert draws.exceptAll(again).count() == 0
    assert resample.cell_draws(df.limit(0), ["g"], ["v"], n=5).count() == 0


def test_more_kinds_than_draws_can_take_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(resample, "MOST_KINDS", 5)
    with pytest.raises(Exception, match="more than 5 kinds"):
        resample.cell_draws(spark.range(6).select(F.lit(1).alias("g"), "id"), ["g"], ["id"], n=2).collect()


@pytest.mark.parametrize("size", [12, 900])
def test_intervals_are_those_of_an_exact_bootstrap(spark, size):
    rng = np.random.default_rng(size)
    a = rng.integers(1, 6, size)
    b = np.clip(a + rng.integers(-1, 2, size), 1, 5)
    df = spark.createDataFrame([("x", "y", str(i), "t", "p", "s", int(u), int(v)) for i, (u, v) in enumerate(zip(a, b, strict=True))], "rater_a string, rater_b string, case_study_id string, tag string, principle string, conversation_source string, va int, vb int")
    got = bootstrap.ac2_from_cells(df, n=2000).first()
    draws = [bootstrap.ac2_metric(a[d], b[d]) for d in rng.integers(0, size, (20_000, size))]
    want = bootstrap.summary(np.array(draws))
    assert got.ac2 == pytest.approx(agreement.ac2(df).first().ac2) and got.n == size and got.num_samples == 2000
    spread = want[1]
    assert abs(got.stddev / spread - 1) < 0.12
    assert abs(got["mean"] - want[0]) < 0.1 * spread and abs(got.ci_lower - want[4]) < 0.25 * spread and abs(got.ci_upper - want[5]) < 0.25 * spread
    mean = bootstrap.cell_bootstrap(df, ["rater_a"], "va", n=2000).first()
    low, high = np.percentile(a[rng.integers(0, size, (2000, size))].mean(1), [2.5, 97.5])
    assert mean["mean"] == pytest.approx(a.mean()) and abs(mean.low - low) < 0.2 * a.std() / size**0.5 and abs(mean.high - high) < 0.2 * a.std() / size**0.5


def test_exact_draws_are_the_same_whatever_tasks_make_them(spark):
    """One group, many tasks: the numbers of one generator that goes through all draws, bit by bit."""
    rng = np.random.default_rng(4)
    y, p, q = rng.integers(0, 2, 61), rng.integers(1, 6, 61), np.round(rng.normal(size=61), 1)
    rows = [("g", f"{i:03}", int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(y, p, q, strict=True))]
    df = spark.createDataFrame(rows, "g string, id string, y int, p int, q double").repartition(5)
    own = [bootstrap.AC2, bootstrap.Metric("mean of the positive", lambda a, b: float(b[a == 1].mean()), binary=True)]
    got = {(r.model_name, r.metric_name): r for r in bootstrap.exact_bootstrap(df, ["g"], "id", "y", ["p", "q"], own, n=130).collect()}
    draws = bootstrap.sample_indices(y, 130, both_classes=True)
    for name, x in (("p", p), ("q", q)):
        for m in own:
            r = got[name, m.name]
            assert (r["mean"], r.stddev, r.num_samples, r.ci_level, r.ci_lower, r.ci_upper) == bootstrap.summary(np.array([m.function(y[d], x[d]) for d in draws]))
    chunks = list(bootstrap._chunks(df.toPandas(), "id", "y", ["p", "q"], 130, 42, True))
    assert [c[:2] for c in chunks] == [(0, 50), (1, 50), (2, 30)] and len({c[2] for c in chunks}) == 3
