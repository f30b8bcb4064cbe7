"""Running sums, numbers and percentiles by ranges, against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.operators import bootstrap, outcomes, prefix, ratings_stats


def test_running_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), k, rng.randrange(10), 1) for k in rng.sample(range(10_000), 700)]
    got = prefix.running_sums(spark.createDataFrame(rows, "g string, k int, n bigint, one bigint").repartition(6), ["g"], ["k"], ["n", "one"]).collect()
    assert len(got) == 700
    for r in got:
        before = [x for x in rows if x[0] == r.g and x[1] < r.k]
        assert (r.before_n, r.before_one) == (sum(x[2] for x in before), len(before))
    whole = prefix.running_sums(spark.createDataFrame(rows, "g string, k int, n bigint, one bigint"), [], ["k"], ["one"]).collect()
    assert sorted(r.before_one for r in whole) == list(range(700))
    assert prefix.running_sums(spark.createDataFrame([], "g string, k int, n bigint"), ["g"], ["k"], ["n"]).count() == 0


def test_numbers(spark):
    rows = [(i % 7, f"r{i}") for i in range(500)] + [(3, "same")] * 200
    df = spark.createDataFrame(rows, "k int, `a.b` string").repartition(5)
    got = sorted(prefix.numbered(df, ["k"]).collect(), key=lambda r: r["index"])
    assert [r["index"] for r in got] == list(range(700)) and [r.k for r in got] == sorted(r.k for r in got)
    last = prefix.numbered(df, [-F.col("k")], start=1).filter("k = 6").agg(F.min("index"), F.max("index")).first()
    assert tuple(last) == (1, sum(k == 6 for k, _ in rows)) and prefix.numbered(df.limit(0), ["k"]).count() == 0
    plan = prefix.numbered(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1 and "collect_list(struct(_range" in plan  # the ranges' sums alone come together


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], list(map(float, range(101))), [3.0] * 50 + [None] * 4, [float(x) for x in np.random.default_rng(1).normal(size=999)]])
def test_percentiles(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [("none", None)], "g string, v double").repartition(4)
    r = prefix.percentiles(df, ["g"], "v", {"a": 0.025, "m": 0.5, "b": 0.975, "top": 1.0}).collect()
    kept = [v for v in values if v is not None]
    assert len(r) == 1 and np.allclose([r[0].a, r[0].m, r[0].b, r[0].top], np.percentile(kept, [2.5, 50, 97.5, 100]))
    whole = prefix.percentiles(df, [], "v", {"m": 0.3}).first()
    assert whole.m == pytest.approx(np.percentile(kept, 30))


def test_intervals_and_rank_sums_agree_with_those_in_one_task(spark):
    rng = np.random.default_rng(2)
    rows = [(str(rng.choice(["a", "b"])), str(rng.choice(["x", "y", "z"])), float(v)) for v in np.round(rng.normal(size=900), 2)]
    df = spark.createDataFrame(rows, "tag string, conversation_source string, rating double").repartition(4)
    one, many = (sorted(map(tuple, ratings_stats.rank_sums(df, many_levels=m).collect())) for m in (False, True))
    assert len(one) == 12 and [r[:4] for r in one] == [r[:4] for r in many] and np.allclose([r[4:] for r in one], [r[4:] for r in many])
    a, b = (sorted(map(tuple, f(df, ["tag"], "rating").collect())) for f in (bootstrap.intervals, bootstrap.exact_intervals))
    assert [r[0] for r in a] == [r[0] for r in b] and np.allclose([r[1:] for r in a], [r[1:] for r in b])


def test_auroc_of_many_scores(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 800), np.round(rng.normal(size=800), 2)
    s = s + y * 0.5
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    df = spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(y, s, strict=True)], "k string, y int, s double").repartition(5)
    assert outcomes.auroc(df, ["k"], "y", "s").first().auroc == pytest.approx(want)
    assert outcomes.auroc(df.filter("y = 1"), ["k"], "y", "s").first().auroc is None


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """A task holds a range of bounded size: more rows are more ranges."""
    monkeypatch.setattr(prefix, "ROWS", 50)
    df = spark.range(1000).select(F.lit("g").alias("g"), "id", F.lit(1).cast("bigint").alias("n"))
    ranged, n = prefix._ranges(df, ["g", "id"])
    assert n == 20 and ranged.groupBy("_range").count().agg(F.max("count")).first()[0] < 200
    assert [(r.id, r.before_n) for r in prefix.running_sums(df, ["g"], ["id"], ["n"]).orderBy("id").collect()] == [(k, k) for k in range(1000)]
    assert [r["index"] for r in prefix.numbered(df, ["id"]).orderBy("id").collect()] == list(range(1000))


def test_rank_sums_do_not_hold_cells_by_group(spark):
    """Pairs of sources are sent to the cells, whatever the planner knows: no group's cells are in one task."""
    rows = spark.range(40).select(F.concat(F.lit("g"), F.col("id") % 2).alias("tag"), F.concat(F.lit("s"), F.col("id") % 3).alias("conversation_source"), F.col("id").cast("double").alias("rating"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ratings_stats.rank_sums(rows)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan
