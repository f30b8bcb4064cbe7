"""Outcome predictions: names taken apart, ordered, joined with prevalence, with error bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell import fixed_values as fixed
from ratewell.functions.scalar import place_in
from ratewell.operators.prefix import running_sums


def named(df: DataFrame, targets: Mapping[str, str] = fixed.OUTCOMES, models: Mapping[str, str] = fixed.OUTCOME_MODELS) -> DataFrame:
    """Adds Target and Model from ``prediction_name``: the first target that it begins with, and the model of the rest.

    An unknown rest leaves the target's own prefix and an empty model. No known target is an error.
    """
    name, target, model = F.col("prediction_name"), F.lit(None).cast("string"), F.lit(None).cast("string")
    known = F.create_map(*(F.lit(x) for pair in models.items() for x in pair))
    for prefix, label in reversed(targets.items()):
        found, rest = known[F.substring(name, F.lit(len(prefix) + 1), F.length(name))], F.startswith(name, F.lit(prefix))
        target = F.when(rest, F.when(found.isNull(), prefix).otherwise(label)).otherwise(target)
        model = F.when(rest, F.coalesce(found, F.lit(""))).otherwise(model)
    bad = F.raise_error(F.concat(F.lit("no known outcome: "), F.coalesce(name, F.lit("null")))).cast("string")
    return df.withColumns({"Target": F.coalesce(target, bad), "Model": model})


def ordered(df: DataFrame, models: Sequence[str] = tuple(fixed.OUTCOME_MODELS.values()), targets: Sequence[str] = tuple(fixed.OUTCOMES.values())) -> DataFrame:
    """The named models only, with their place in reports: by model, then target."""
    return df.filter(F.col("Model").isin(*models)).withColumns({"model_place": place_in(F.col("Model"), models), "target_place": place_in(F.col("Target"), targets)})


def with_prevalence(df: DataFrame, prevalence: DataFrame) -> DataFrame:
    """Appends the prevalence of each outcome, which is what a random guess reaches on the precision-recall curve."""
    return df.unionByName(prevalence, allowMissingColumns=True)


def random_baseline(metric: str, prevalence: DataFrame) -> DataFrame:
    """(Target, baseline): 0.5 for the area under the ROC curve, else the prevalence."""
    return prevalence.select("Target", (F.lit(0.5) if metric == "auc" else F.col("mean")).alias("baseline"))


def error_bars(df: DataFrame) -> DataFrame:
    return df.withColumns({"err_low": F.col("mean") - F.col("ci_lower"), "err_high": F.col("ci_upper") - F.col("mean")})


def auroc(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """(by, auroc) by mid-ranks over counts per score; null without both classes. Scores are summed up by ranges, so a group
    may have any number of them. (Our addition.)"""
    counts = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    wins = running_sums(counts, by, [score], ["q"]).withColumn("w", F.col("p") * (F.col("before_q") + F.col("q") / 2))
    return wins.groupBy(*by).agg((F.sum("w") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auroc"))
