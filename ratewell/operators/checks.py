"""Constraints: each gives a frame (check, item) of violations; enforce() turns violations into an error."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import fixed_values as fixed
from ratewell.functions.scalar import repeats_tag_role
from ratewell.sources.schemas import FITNESS_INPUTS


class ConstraintError(ValueError):
    """Data that breaks a constraint; the message names the first few violations."""


def found(df: DataFrame, check: str, item: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), item.cast("string").alias("item"))


def enforce(violations: DataFrame, show: int = 5) -> None:
    rows = violations.orderBy("check", "item").take(show)
    if rows:
        raise ConstraintError("; ".join(f"{r.check}: {r.item}" for r in rows))


def all_of(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def rater_set(ratings: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Raters that aren't expected, and expected ones that are missing."""
    here = ratings.select("rater").distinct()
    expected = ratings.sparkSession.createDataFrame([(r,) for r in raters], "rater string")
    return all_of(found(here.join(expected, "rater", "left_anti"), "unexpected rater", F.col("rater")), found(expected.join(here, "rater", "left_anti"), "missing rater", F.col("rater")))


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return found(df.groupBy(*keys).count().filter("count > 1"), "duplicate " + ", ".join(keys), F.concat_ws("::", *keys))


def fractions(values: Sequence[float]) -> None:
    """Shares of splits: none negative, summing to 1."""
    if any(v < 0 for v in values) or abs(sum(values) - 1) > 1e-8:
        raise ConstraintError(f"fractions must be 0 or more and sum to 1: {list(values)}")


def splits_partition(splits: DataFrame, ids: DataFrame, id_col: str = "case_study_id") -> DataFrame:
    """Each id in exactly one split: ids left out, ids not known, ids in two splits or twice in one."""
    times = splits.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    every = ids.select(id_col).distinct()
    return all_of(
        found(every.join(times, id_col, "left_anti"), "in no split", F.col(id_col)),
        found(times.join(every, id_col, "left_anti"), "not an id", F.col(id_col)),
        found(times.filter("n > 1"), "in several splits", F.col(id_col)),
    )


def splits_disjoint(one: DataFrame, other: DataFrame, id_col: str = "case_study_id") -> DataFrame:
    """Two groups' splits, before they are merged: ids that a split has twice, in one group or both."""
    return unique(one.select("split", id_col).unionByName(other.select("split", id_col)), "split", id_col)


def one_conversation(conversations: DataFrame) -> DataFrame:
    return unique(conversations, "conversation_source", "case_study_id")


def tag_roles(conversations: DataFrame) -> DataFrame:
    return found(conversations.filter(repeats_tag_role(F.col("messages"))), "duplicate (tag, role)", F.col("conversation_id"))


def rating_range(ratings: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    return found(ratings.filter(F.col("rating").isNull() | ~F.col("rating").between(low, high)), "rating out of range", F.col("rating"))


def not_empty(df: DataFrame, column: str, id_col: str) -> DataFrame:
    return found(df.filter(F.coalesce(F.length(column), F.lit(0)) == 0), f"empty {column}", F.col(id_col))


def columns(df: DataFrame, expected: Sequence[str]) -> None:
    """All expected columns are there, and expected only once."""
    if len(set(expected)) < len(expected):
        raise ConstraintError(f"names repeat: {list(expected)}")
    if missing := sorted(set(expected) - set(df.columns)):
        raise ConstraintError(f"missing columns: {missing}")


def binary_label(df: DataFrame, label: str) -> DataFrame:
    """Only 0 and 1, and both of them."""
    state = df.agg(F.min(label).alias("low"), F.max(label).alias("high"), F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).alias("other"))
    return found(state.filter("not (low <=> 0 and high <=> 1 and other = 0)"), f"{label} is not binary with both classes", F.format_string("low=%s high=%s other=%s", "low", "high", "other"))


def interval_rows(results: DataFrame) -> DataFrame:
    """Results of samples: at least one, a level in (0, 100], no spread from one sample, names given."""
    single = (F.col("num_samples") == 1) & ((F.col("stddev") != 0) | (F.col("ci_lower") != F.col("mean")) | (F.col("ci_upper") != F.col("mean")))
    bad = (F.col("num_samples") < 1) | single | (F.col("ci_level") <= 0) | (F.col("ci_level") > 100) | (F.coalesce(F.length("model_name"), F.lit(0)) == 0) | (F.coalesce(F.length("prediction_name"), F.lit(0)) == 0)
    return found(results.filter(bad), "impossible interval", F.concat_ws("::", "model_name", "prediction_name", "metric_name"))


def holdout_pairs(cases: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """holdout and holdout_model hold the same ids with the same inputs (null-safe)."""
    packed = F.struct(*inputs)
    a = cases.filter("split = 'holdout'").select("case_study_id", packed.alias("x"), F.lit(True).alias("in_a"))
    b = cases.filter("split = 'holdout_model'").select("case_study_id", packed.alias("y"), F.lit(True).alias("in_b"))
    both = a.join(b, "case_study_id", "full")
    return found(both.filter(F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("x").eqNullSafe(F.col("y"))), "holdout differs from holdout_model", F.col("case_study_id"))


#: Rows, ids, users and rows per split of the published data sets.
CASE_COUNTS = {
    "sleep": {"rows": 557, "ids": 507, "users": 507, "train": 319, "validation": 69, "test": 69, "holdout": 50, "holdout_model": 50},
    "fitness": {"rows": 400, "ids": 350, "users": 58, "train": 210, "validation": 45, "test": 45, "holdout": 50, "holdout_model": 50},
}


def case_data(cases: DataFrame, vertical: str, expected: dict[str, int] | None = None) -> DataFrame:
    """Counts of a case-study data set, its vertical and splits, and its holdout pairs."""
    expected = expected or CASE_COUNTS[vertical]
    counts = [F.count(F.lit(1)).alias("rows"), F.count_distinct("case_study_id").alias("ids"), F.count_distinct("user_id").alias("users")]
    counts += [F.count_if(F.col("split") == s).alias(s) for s in fixed.CASE_SPLITS]
    got = cases.agg(*counts).select(F.explode(F.create_map(*(x for n in expected for x in (F.lit(n), F.col(n))))).alias("name", "n"))
    wrong = reduce(lambda a, b: a | b, ((F.col("name") == n) & (F.col("n") != v) for n, v in expected.items()))
    strange = cases.filter((F.col("vertical") != vertical) | ~F.col("split").isin(*fixed.CASE_SPLITS) | F.col("split").isNull() | F.col("vertical").isNull())
    return all_of(
        found(got.filter(wrong), "unexpected count", F.concat_ws("=", "name", "n")),
        found(strange, "unknown vertical or split", F.col("case_study_id")),
        holdout_pairs(cases, ("input",) if vertical == "sleep" else FITNESS_INPUTS + ("demographics_output", "training_load_output", "sleep_output")),
    )


def difficulty_all_or_none(exam: DataFrame) -> DataFrame:
    return found(exam.agg(F.count("difficulty").alias("n"), F.count(F.lit(1)).alias("all")).filter("n not in (0, `all`)"), "difficulty on some rows only", F.concat_ws("/", "n", "all"))


def exam_items(exam: DataFrame, id_col: str) -> DataFrame:
    """Question, choices and domain are given, the domain is known, and the letters are the first ones in order."""
    letters = F.slice(F.array(*map(F.lit, fixed.EXAM_OPTIONS)), 1, F.size("choices"))
    fine = (F.length("question") > 0) & (F.size("choices") > 0) & F.col("domain").isin(*fixed.EXAM_DOMAINS) & (F.array_sort(F.map_keys("choices")) == letters)
    return found(exam.filter(~F.coalesce(fine, F.lit(False))), "malformed question", F.col(id_col))


def pair_count(pairs: DataFrame, expected: int) -> DataFrame:
    """The number of pairs of raters, if it isn't the expected one."""
    got = pairs.select("rater_a", "rater_b").distinct().agg(F.count(F.lit(1)).alias("n"))
    return found(got.filter(F.col("n") != expected), f"expected {expected} pairs of raters", F.col("n"))
