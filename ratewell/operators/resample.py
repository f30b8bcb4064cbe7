"""Resamples drawn as counts: how often each kind of row is in a bootstrap sample, at a cost that doesn't know how many rows
there are."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.operators.checks import columns

SEED = 42
#: Below this mean a binomial number is found by adding up probabilities, above it from a normal one.
FEW = 12.0
#: Kinds of rows that a group may have: its draws go through them one after another.
MOST_KINDS = 10_000


def hash_share(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 32 bits of an md5 of the parts, alike on every engine."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def deviate(u: Column, v: Column) -> Column:
    """A normal number from two uniform ones, after Box and Muller."""
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def binomial(n: Column, p: Column, u: Column, v: Column) -> Column:
    """How many of n succeed, each with probability p, from two uniform numbers.

    The less likely outcome is counted. With a mean below FEW it is the least number whose probabilities up to it reach u,
    exactly. Otherwise a normal number is bent by the skewness and rounded: mean and variance are those of the binomial to
    one in a hundred, and probabilities up to a number are off by less than 0.003. Either way the work is bounded, whatever
    n is.
    """
    rare = F.least(p, 1 - p)
    given = F.struct(n.cast("double").alias("n"), p.alias("p"), rare.alias("rare"), (n * rare).alias("mean"), u.alias("u"), v.alias("v"))

    def step(s: Column, k: Column) -> Column:
        more = s["one"] * (s["n"] - k + 1) / k * s["odds"]
        return F.when(s["u"] <= s["upto"], s).otherwise(F.struct(more.alias("one"), (s["upto"] + more).alias("upto"), k.alias("at"), s["n"].alias("n"), s["odds"].alias("odds"), s["u"].alias("u")))

    def counted(g: Column) -> Column:
        none = F.exp(g["n"] * F.ln(1 - g["rare"]))
        start = F.struct(none.alias("one"), none.alias("upto"), F.lit(0.0).alias("at"), g["n"].alias("n"), (g["rare"] / (1 - g["rare"])).alias("odds"), g["u"].alias("u"))
        # u has 33 bits: no number further out than this can be found.
        ladder = F.transform(F.sequence(F.lit(1), F.ceil(g["mean"] + 7 * F.sqrt(g["mean"]) + 12).cast("int")), lambda k: k.cast("double"))
        return F.least(F.aggregate(ladder, start, step)["at"], g["n"])

    def bent(g: Column) -> Column:
        near = _bound(deviate(g["u"], g["v"]), lambda z: F.floor(g["mean"] + F.sqrt(g["mean"] * (1 - g["rare"]) - 1 / 12) * z + (1 - 2 * g["rare"]) * (z * z - 1) / 6 + 0.5))
        return F.greatest(F.lit(0.0), F.least(g["n"], near.cast("double")))

    def found(g: Column) -> Column:
        either = _bound(F.when(g["mean"] < FEW, counted(g)).otherwise(bent(g)), lambda x: F.when(g["p"] <= 0.5, x).otherwise(g["n"] - x))
        return F.when((g["n"] <= 0) | (g["p"] <= 0), F.lit(0.0)).when(g["p"] >= 1, g["n"]).otherwise(either)

    return _bound(given, found).cast("bigint")


def cell_draws(df: DataFrame, by: Sequence[str], values: Sequence[str], n: int = 1000, seed: int = SEED) -> DataFrame:
    """(by, draw, values, w): how many rows with these values each of n resamples of a group has; zeros are left out.

    A resample of N rows with replacement has multinomial counts of its cells. Rows are reduced to cells by one shuffle with
    partial sums; in each draw a cell then takes a binomial share of what the cells before it left, so that every draw has N
    rows. The random numbers are hashes of seed, draw, group and cell: a lost task gives the same ones again. Rows with a
    null among the values don't take part. More than MOST_KINDS kinds in a group are an error: use weighted_bootstrap.
    """
    columns(df, [*by, *values])
    spark = df.sparkSession
    counts = df.dropna(subset=list(values)).groupBy(*by, *values).agg(F.count(F.lit(1)).alias("_n"))
    cell = F.struct(*values, "_n")
    groups = counts.groupBy(*by).agg(F.array_sort(F.collect_list(cell)).alias("_cells"), F.sum("_n").alias("_rows"))
    fits = F.when(F.size("_cells") <= MOST_KINDS, F.col("_cells")).otherwise(F.raise_error(F.lit(f"a group has more than {MOST_KINDS} kinds of rows")).cast(groups.schema["_cells"].dataType))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = groups.select(*by, fits.alias("_cells"), "_rows", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw")).repartition(tasks, *by, "draw")
    key = [str(seed), F.col("draw"), *(F.col(c) for c in by)]

    def take(s: Column, c: Column) -> Column:
        own = [*key, *(c[v] for v in values)]
        share = binomial(s["left"], c["_n"] / s["mass"], hash_share(*own, "a"), hash_share(*own, "b"))
        return _bound(share, lambda w: F.struct((s["left"] - w).alias("left"), (s["mass"] - c["_n"]).alias("mass"), F.concat(s["taken"], F.array(w)).alias("taken")))

    start = F.struct(F.col("_rows").alias("left"), F.col("_rows").alias("mass"), F.array().cast("array<bigint>").alias("taken"))
    weights = F.aggregate("_cells", start, take, lambda s: s["taken"])
    each = drawn.select(*by, "draw", F.inline(F.arrays_zip(F.col("_cells").alias("c"), weights.alias("w"))))
    return each.filter("w > 0").select(*by, "draw", *(F.col(f"c.{v}") for v in values), "w")
