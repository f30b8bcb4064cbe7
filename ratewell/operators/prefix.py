"""Running sums, row numbers and percentiles of any number of rows in one order, without a task that sees them all.

Rows are cut into ranges of the order, each range is summed up by itself, and the sums of the ranges before it are joined
back: a task holds one range, and what is gathered is a number for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.operators.checks import columns
from ratewell.sources.scratch import saved


#: Rows of one range, about: with more rows there are more ranges, so a task holds no more than before.
ROWS = 1_000_000


def _ranges(df: DataFrame, keys: Sequence[Column | str]) -> tuple[DataFrame, int]:
    """The same rows with ``_range``, the number of the range of ``keys`` that they lie in (equal keys are in one range), and
    how many ranges there are. The rows are written, so that every later pass sees the same ranges."""
    rows = saved(df)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    return saved(rows.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id())), n


def _before(totals: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, _range, values): for each range, the sums of those before it. A group has as many rows here as it has ranges."""
    lists = totals.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_range", *values))).alias("_all"))

    def upto(v: str) -> Column:
        return F.aggregate(F.slice("_all", 1, F.col("_at")), F.lit(0).cast(totals.schema[v].dataType), lambda s, x: s + x[v]).alias(v)

    up = [upto(v) for v in values]
    each = lists.select(*by, "_all", F.posexplode(F.transform("_all", lambda x: x["_range"])).alias("_at", "_range"))
    return each.select(*by, "_range", *up)


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The rows of df and ``before_<value>``: the sum of each value over the rows of the group that come before in the order.

    Each (by, order) should be one row: reduce rows to cells first. Values are whole numbers or decimals, whose sums don't
    depend on how they are added up. A group may be as large as the table.
    """
    columns(df, [*by, *order, *values])
    ranged, n = _ranges(df, [*by, *order])
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.repartition(n, "_range", *by).withColumns({f"before_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    sums = _before(ranged.groupBy(*by, "_range").agg(*(F.sum(v).alias(v) for v in values)), by, values)
    renamed = sums.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(by)), F.col("_range").alias("_r"), *(F.col(v).alias(f"_b_{v}") for v in values))
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    joined = local.join(renamed, same)
    return joined.select(*df.columns, *((F.col(f"before_{v}") + F.col(f"_b_{v}")).alias(f"before_{v}") for v in values))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "index", start: int = 0) -> DataFrame:
    """The rows of df and their number in the order; of equal rows either comes first. Rows that the order doesn't tell
    apart are told apart by a hash of all columns, so that very many of them can be in several ranges."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    tie = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns))
    keyed = df.withColumns({**{f"_k{k}": c for k, c in enumerate(keys)}, "_tie": tie})
    names = [*(f"_k{k}" for k in range(len(keys))), "_tie"]
    ranged, n = _ranges(keyed, names)
    local = ranged.repartition(n, "_range").withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*names)))
    before = _before(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")), [], ["_n"])
    place = (F.col("_place") + F.col("_n") + (start - 1)).cast("bigint")
    return local.join(F.broadcast(before), "_range").select(*(F.col(f"`{c}`") for c in df.columns), place.alias(name))  # a row for each range


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): exact percentiles, interpolated between the two values around them; at any size.

    Rows are reduced to counts of equal values, running counts say which values stand at the wanted places, and only those go
    on. No task holds the values of a group. Nulls don't count; a group of nulls only isn't there.
    """
    cells = df.dropna(subset=[value]).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sums(cells, by, ["_v"], ["_n"])
    sizes = cells.groupBy(*by).agg(F.sum("_n").alias("_rows"))
    joined = placed.join(sizes.select(*(F.col(c).alias(f"_s{k}") for k, c in enumerate(by)), "_rows"), _same(by)) if by else placed.crossJoin(F.broadcast(sizes))  # one row
    found = []
    for k, share in enumerate(shares.values()):
        place = (F.col("_rows") - 1) * share
        for end, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            there = (F.col("before__n") <= at) & (at < F.col("before__n") + F.col("_n"))
            found.append(F.max(F.when(there, F.col("_v"))).alias(f"_{end}{k}"))
    ends = joined.groupBy(*by).agg(F.first("_rows").alias("_rows"), *found)
    out = []
    for k, (name, share) in enumerate(shares.items()):
        place = (F.col("_rows") - 1) * share
        out.append((F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * (place - F.floor(place))).alias(name))
    return ends.select(*by, *out)


def _same(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for k, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"_s{k}"))
    return out
