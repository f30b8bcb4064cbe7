"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.texts import stored

#: Order of nodes in each round: ids are compared after an exclusive or with the round's constant, so that long
#: paths of rising ids contract as fast as others.
_SEEDS = (0x0, 0x5DEECE66D1234567, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x6C62272E07BB0142)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b, long); nodes are connected exactly if their roots are equal.

    Each round points every node at the least of itself and its neighbours (in the round's order), then replaces the
    edges by edges between those targets. Edges only shrink, and a node with very many edges is reduced by partial
    aggregation. Each round's edges are written and read back, which cuts the lineage and leaves the next round's plan
    as small as the first (a checkpoint would hand on all constraints inferred so far). Null ends are dropped.
    """
    edges = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna().distinct())
    steps: list[DataFrame] = []
    left = edges.filter("a <> b")
    for round_ in range(most_rounds):
        if left.isEmpty():
            break
        seed = F.lit(_SEEDS[round_ % len(_SEEDS)]).cast("long")
        both = left.select("a", "b").union(left.select("b", "a")).toDF("node", "next")
        step = (
            both.groupBy("node").agg(F.min(F.col("next").bitwiseXOR(seed)).alias("near"))
            .select("node", F.least("near", F.col("node").bitwiseXOR(seed)).bitwiseXOR(seed).alias("to"))
        )
        step = stored(step)
        steps.append(step)
        left = (
            left.join(step.toDF("a", "p"), "a").join(step.toDF("b", "q"), "b")
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).filter("a <> b").distinct()
        )
        left = stored(left)
    else:
        if not left.isEmpty():
            raise RuntimeError(f"edges are left after {most_rounds} rounds")
    nodes = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    for step in steps:
        nodes = nodes.join(step.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return nodes
