"""Means and contingency counts of ratings as they arrive (an addition: both are sums, so they merge)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_means(ratings: DataFrame, group: str = "tag") -> DataFrame:
    """Mean rating and count by group and source, for output mode "complete" or "update"."""
    return ratings.groupBy(group, "conversation_source").agg(F.avg("rating").alias("mean_rating"), F.count("rating").alias("n"))


def windowed_counts(ratings: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Ratings by source, rating and window of event time; rows later than ``late`` don't count."""
    return ratings.withWatermark(time, late).groupBy(F.window(time, window), "conversation_source", "rating").agg(F.count(F.lit(1)).alias("n"))
