"""Case studies: demographics out of their texts, and tables of who they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell import fixed_values as fixed
from ratewell.functions.scalar import first_line, lookup
from ratewell.operators import prefix


def sleep_demographics(cases: DataFrame, text: str = "input") -> DataFrame:
    """Adds sex, age_bucket and age (the bucket's midpoint) from a first line such as
    ``The user is female, [40-44] years old.``; null where the line says nothing."""
    line = first_line(F.col(text))
    sex = F.nullif(F.regexp_extract(line, r"^The user is (female|male),", 1), F.lit(""))
    bucket = F.nullif(F.regexp_extract(line, r"male, (.*) years old\.$", 1), F.lit(""))
    return cases.withColumns({"sex": F.initcap(sex), "age_bucket": bucket, "age": lookup(bucket, fixed.AGE_MIDPOINTS)})


def fitness_demographics(cases: DataFrame, text: str = "demographics_input") -> DataFrame:
    """Adds age, height, weight, bmi and gender from lines 1 to 4 and the last."""
    lines = F.split(text, "\n")
    number = lambda i, name, unit: F.regexp_extract(F.get(lines, F.lit(i)), rf"^{name}: ([0-9.]+){unit}", 1).try_cast("double")
    age = F.regexp_extract(F.get(lines, F.lit(0)), r"^Age: (.*)$", 1)
    gender = F.nullif(F.regexp_extract(F.try_element_at(lines, F.lit(-1)), r"^Gender: (Male|Female)$", 1), F.lit(""))
    return cases.withColumns({
        "age": F.coalesce(lookup(age, fixed.AGE_MIDPOINTS).cast("double"), age.try_cast("double")), "height": number(1, "Height", "m"), "weight": number(2, "Weight", "kg"), "bmi": number(3, "BMI", ""), "gender": gender,
    })


def unparsed(cases: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(check, item) of cases whose text doesn't give a field."""
    from ratewell.operators.checks import all_of, found

    return all_of(*(found(cases.filter(F.col(f).isNull()), f"no {f}", F.col("case_study_id")) for f in fields))


def last_per_user(cases: DataFrame, order: str, user: str = "user_id") -> DataFrame:
    """The last row of each user by ``order``. Partial aggregation keeps one row per user and task."""
    packed = F.struct(*[c for c in cases.columns if c != user])
    return cases.groupBy(user).agg(F.max_by(packed, order).alias("r")).select(user, "r.*")


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def fixed_histogram(df: DataFrame, value: str, low: float = 25, width: float = 5, bins: int = 12) -> DataFrame:
    """(bin, low, high, n) for every bin, with zeros; the last bin is closed. Values outside aren't counted."""
    high = low + width * bins
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width)).cast("int")
    got = df.filter(F.col(value).between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(got), "bin", "left").select("bin", (low + width * F.col("bin")).cast("double").alias("low"), (low + width * (F.col("bin") + 1)).cast("double").alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def equal_width_histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Likewise between the smallest and the largest value. With one value all are in the first bin."""
    ends = df.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b"))
    spread = F.nullif(F.col("b") - F.col("a"), F.lit(0.0))
    place = F.least(F.lit(bins - 1), F.coalesce(F.floor(bins * (F.col(value) - F.col("a")) / spread), F.lit(0))).cast("int")
    got = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends: one row
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    edge = lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / bins
    return grid.join(F.broadcast(got), "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds ``line``, from 1, in the order of ``order``, for tables that came without one; by ranges, not in one task."""
    return prefix.numbered(df, [order], "line", 1)
