"""Splits of case studies, stratified by the set of raters who rated each."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewell.operators.checks import fractions as check_fractions

FRACTIONS = {"train": 0.8, "validation": 0.2, "test": 0.0, "holdout": 0.0}
SEED = 42


def rater_sets(ratings: DataFrame, id_col: str = "case_study_id") -> DataFrame:
    """(id, raters): the sorted set of raters of each case; a set is as large as the panel of raters."""
    return ratings.groupBy(id_col).agg(F.array_sort(F.collect_set("rater")).alias("raters"))


def ids_by_rater_set(ratings: DataFrame, id_col: str = "case_study_id") -> DataFrame:
    """(raters, n_ids), the largest group first, ties by raters."""
    return rater_sets(ratings, id_col).groupBy("raters").agg(F.count(F.lit(1)).alias("n_ids")).orderBy(F.desc("n_ids"), "raters")


def stratified_split(ratings: DataFrame, id_col: str = "case_study_id", fractions: Mapping[str, float] = FRACTIONS, seed: int = SEED) -> DataFrame:
    """(id, raters, split): in each group of cases with one set of raters, a seeded shuffle is cut at the summed fractions.

    The shuffle is the order of md5(seed:id), so it doesn't depend on partitioning. A cut is the whole part of the
    summed fraction of the group's size. Ids are numbered within the first four digits of their md5, and those cells
    (65,536 at most) within the group, so a group of any size is spread over tasks.
    """
    check_fractions(list(fractions.values()))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    sets = rater_sets(ratings, id_col).withColumns({"_order": order, "_cell": F.substring(order, 1, 4)})
    by_group = Window.partitionBy("raters")
    upto = F.sum("_n").over(by_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = sets.groupBy("raters", "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_before": F.coalesce(upto, F.lit(0)), "n": F.sum("_n").over(by_group)})
    own = F.row_number().over(Window.partitionBy("raters", "_cell").orderBy("_order", id_col))
    placed = sets.withColumn("_own", own).join(cells, ["raters", "_cell"]).withColumn("place", F.col("_before") + F.col("_own"))
    split, total = F.lit(None).cast("string"), 0.0
    for name, share in reversed(list(zip(fractions, np.cumsum(list(fractions.values())), strict=True))):
        total = float(share)
        split = F.when(F.col("place") <= F.floor(F.col("n") * total + 1e-9), name).otherwise(split)
    return placed.select(id_col, "raters", split.alias("split"))


def numpy_split(ratings: DataFrame, id_col: str = "case_study_id", fractions: Mapping[str, float] = FRACTIONS, seed: int = SEED) -> DataFrame:
    """Likewise with numpy's shuffle of each group's sorted ids, for exact agreement with runs made that way.

    A group comes to one task: for groups of case studies, of which there are hundreds. Ids sort in their own type.
    """
    check_fractions(list(fractions.values()))
    kind = ratings.schema[id_col].dataType.simpleString()

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.array(sorted(group[id_col]))
        np.random.default_rng(seed).shuffle(ids)
        cuts = (np.cumsum(list(fractions.values())) * len(ids)).astype(int)
        return pd.DataFrame({id_col: ids, "split": np.array(list(fractions))[np.searchsorted(cuts, np.arange(len(ids)), "right")]})

    return rater_sets(ratings, id_col).groupBy("raters").applyInPandas(cut, f"{id_col} {kind}, split string")


def merge(*splits: DataFrame, id_col: str = "case_study_id") -> DataFrame:
    """(id, split) of several groups together."""
    out = splits[0].select(id_col, "split")
    for s in splits[1:]:
        out = out.unionByName(s.select(id_col, "split"))
    return out


def split_stats(ratings: DataFrame, splits: DataFrame, id_col: str = "case_study_id") -> DataFrame:
    """(split, tag, n_ratings, n_cases) per tag, and with tag null for the whole split. Splits without ratings have no row."""
    both = ratings.join(splits.select(id_col, "split"), id_col)
    counts = [F.count(F.lit(1)).alias("n_ratings"), F.count_distinct(id_col).alias("n_cases")]
    return both.groupingSets([["split", "tag"], ["split"]], "split", "tag").agg(*counts)
