"""Mean ratings, rank-sum tests with false-discovery control, and which sources lead a section.

Ratings are reduced to counts per (group, source, rating) by one shuffle with partial sums; all that follows works on
those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewell.functions.scalar import two_sided_p
from ratewell.operators.prefix import running_sums


def sections(ratings: DataFrame, sources: Sequence[str] | None = None, drop_overall: bool = True) -> DataFrame:
    """Ratings that a report by section shows."""
    df = ratings.filter("tag <> 'overall'") if drop_overall else ratings
    return df if sources is None else df.filter(F.col("conversation_source").isin(*sources))


def means(ratings: DataFrame, group: str = "tag") -> DataFrame:
    return ratings.groupBy(group, "conversation_source").agg(F.avg("rating").alias("mean_rating"), F.count("rating").alias("n"))


def best_source(ratings: DataFrame, group: str = "tag") -> DataFrame:
    """The source with the highest mean in each group; of equals the first by name."""
    order = Window.partitionBy(group).orderBy(F.desc("mean_rating"), "conversation_source")
    return means(ratings, group).withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place", "n")


def cells(ratings: DataFrame, group: str = "tag") -> DataFrame:
    """(g, s, v, n): how often each source got each rating in each group."""
    return ratings.filter("rating is not null").groupBy(F.col(group).alias("g"), F.col("conversation_source").alias("s"), F.col("rating").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def rank_sums(ratings: DataFrame, group: str = "tag", many_levels: bool = False) -> DataFrame:
    """(g, a, b, n, statistic, p) for every ordered pair of sources in each group.

    The statistic is the rank sum of a's ratings among both, by mid-ranks, standardised without correction for ties.
    Pairs a < b are tested; b against a is the mirror. A pair with a source that isn't rated in the group is absent.
    many_levels: for measurements, of which a group may have as many as rows. Counts are then summed up by ranges of the
    values (a value is in one range, so ties are whole), not in one task for each pair; ratings don't need that.
    """
    c = cells(ratings, group)
    sources = c.select("g", "s").distinct()
    pairs = sources.withColumnRenamed("s", "a").join(sources.withColumnRenamed("s", "b"), "g").filter("a < b")
    # As many rows as the result has. Left to the planner, cells meet them by the group: a group is then one task, or all cells
    # are held in every task.
    both = c.join(F.broadcast(pairs), "g").filter("s = a or s = b").groupBy("g", "a", "b", "v").agg(F.sum(F.when(F.col("s") == F.col("a"), F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("s") == F.col("b"), F.col("n")).otherwise(0)).alias("nb"))
    both = both.withColumn("nn", F.col("na") + F.col("nb"))
    if many_levels:
        counted = running_sums(both, ["g", "a", "b"], ["v"], ["nn"])
    else:
        below = F.sum("nn").over(Window.partitionBy("g", "a", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
        counted = both.withColumn("before_nn", F.coalesce(below, F.lit(0)))
    ranked = counted.withColumn("rank", F.col("before_nn") + (F.col("nn") + 1) / F.lit(2.0))
    sums = ranked.groupBy("g", "a", "b").agg(F.sum(F.col("na") * F.col("rank")).alias("s"), F.sum("na").cast("double").alias("n1"), F.sum("nb").cast("double").alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    z = (F.col("s") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    half = sums.select("g", "a", "b", (n1 + n2).cast("long").alias("n"), z.alias("statistic")).withColumn("p", two_sided_p(F.col("statistic")))
    mirror = half.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "n", (-F.col("statistic")).alias("statistic"), "p")
    return half.unionByName(mirror)


def fdr(tests: DataFrame, by: Sequence[str] = ("a", "b"), p: str = "p", order: Sequence[str] = ("g",)) -> DataFrame:
    """Adds q: p-values adjusted within each family ``by``, after Benjamini and Hochberg. Null p stay out of the count."""
    family = Window.partitionBy(*by)
    rank = F.row_number().over(family.orderBy(F.col(p).asc_nulls_last(), *order))
    scaled = F.col(p) * F.count(p).over(family) / rank
    ahead = family.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("_rank", rank).withColumn("_scaled", scaled).withColumn("q", F.least(F.lit(1.0), F.min("_scaled").over(ahead))).drop("_rank", "_scaled")


def significance(ratings: DataFrame, group: str = "tag", level: float = 0.05) -> DataFrame:
    """(g, a, b, n, statistic, p, q, significant, effect): the tests with adjusted p within each ordered pair of sources."""
    return fdr(rank_sums(ratings, group)).withColumn("significant", F.col("q") < level).withColumn("effect", F.col("statistic") / F.sqrt(F.col("n").cast("double")))


def wide_report(tests: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per group with five columns per pair. The pairs are given, so no extra pass looks for them."""
    names = {"n": "n", "statistic": "statistic", "q": "p-value", "significant": "significance", "effect": "effect size"}
    pick = lambda a, b, c: F.first(F.when((F.col("a") == a) & (F.col("b") == b), F.col(c)), ignorenulls=True).alias(f"{a} vs {b} {names[c]}")
    return tests.groupBy("g").agg(*(pick(a, b, c) for a, b in pairs for c in names))


def significant_pairs(tests: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(g, a, b) of the named pairs that differ."""
    named = tests.sparkSession.createDataFrame(list(pairs), "a string, b string")
    return tests.filter("significant").join(F.broadcast(named), ["a", "b"], "left_semi").select("g", "a", "b")


def alike_pairs(tests: DataFrame) -> DataFrame:
    """(g, a, b) of all ordered pairs that don't differ; groups without any come with nulls."""
    every = tests.select("g").distinct()
    return every.join(tests.filter("not significant").select("g", "a", "b"), "g", "left")


def star_sources(ratings: DataFrame, group: str = "tag") -> DataFrame:
    """(g, source, is_best): the best source of each group, and all that don't differ from it."""
    best = best_source(ratings, group).select(F.col(group).alias("g"), F.col("conversation_source").alias("best"))
    like = significance(ratings, group).filter("not significant").join(best, "g").filter("a = best").select("g", F.col("b").alias("source"), F.lit(False).alias("is_best"))
    return best.select("g", F.col("best").alias("source"), F.lit(True).alias("is_best")).unionByName(like)
