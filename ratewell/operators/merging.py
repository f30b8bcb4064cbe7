"""Metrics that merge: each task keeps a small state of what it has seen, and states are put together afterwards, so that one
group may be spread over all tasks."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.operators.bootstrap import ac2_counted
from ratewell.operators.checks import ConstraintError, columns

#: States that a task holds before it hands them on, and parts in which the states of a group are merged first.
HELD, PARTS = 10_000, 32
RESULT = "prediction_name string, metric_name string, value double, n bigint"


@dataclass(frozen=True)
class Merging:
    """A metric in four steps. ``update`` gets a state and arrays of labels and predictions and gives the new state; ``merge``
    of two states must not depend on their order; states are pickled, so they should stay small however many rows there are."""

    name: str
    init: Callable[[], Any]
    update: Callable[[Any, np.ndarray, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float]


def _pairs(state: Counter, label: np.ndarray, prediction: np.ndarray) -> Counter:
    counts = pd.Series(1, index=pd.MultiIndex.from_arrays([label, prediction])).groupby(level=[0, 1]).sum()
    for pair, n in counts.items():
        state[pair] += int(n)
    return state


def _ac2(state: Counter) -> float:
    rows = sorted(state.items())
    return ac2_counted(np.array([a for (a, _), _ in rows]), np.array([b for (_, b), _ in rows]), np.array([n for _, n in rows]))


def _auroc(state: Counter) -> float:
    """By mid-ranks over counts per score; labels are 0 and 1."""
    scores = sorted({s for _, s in state})
    good, bad = (np.array([state.get((y, s), 0) for s in scores], float) for y in (1, 0))
    both = good.sum() * bad.sum()
    return float((good * (np.cumsum(bad) - bad / 2)).sum() / both) if both else float("nan")


#: Their states are counts of (label, prediction): for ratings and other values with few levels.
AC2 = Merging("gwet_ac2", Counter, _pairs, lambda a, b: a + b, _ac2)
AUROC = Merging("auroc", Counter, _pairs, lambda a, b: a + b, _auroc)


def merged_metrics(df: DataFrame, by: Sequence[str], label: str, predictions: Sequence[str], metrics: Sequence[Merging], mask: Column | None = None) -> DataFrame:
    """(by, prediction_name, metric_name, value, n) of each group, prediction and metric over all of its rows.

    Arrow batches update a state for each group that a task meets. States of one group are merged in PARTS tasks and then in
    one, which sees at most PARTS of them. Rows where the label or a prediction is null, or that the mask drops, don't count.
    value is null where a metric gives nan.
    """
    names = [m.name for m in metrics]
    if not metrics or len(set(names)) < len(names):
        raise ConstraintError(f"metrics need names of their own: {names}")
    columns(df, [*by, label, *predictions])
    used = (df if mask is None else df.filter(mask)).dropna(subset=[label, *predictions]).select(*by, label, *predictions)
    keys = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    state = f"{keys}_p int, _m int, _n bigint, _state binary"
    fields = [*by, "_p", "_m", "_n", "_state"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def flushed() -> pd.DataFrame:
            rows = [(*key, p, i, n, pickle.dumps(s)) for key, (n, states) in held.items() for (p, i), s in states.items()]
            held.clear()
            return pd.DataFrame(rows, columns=fields)

        for batch in batches:
            for key, rows in batch.groupby(list(by), dropna=False, sort=False) if by else [((), batch)]:
                own = held.setdefault(tuple(None if pd.isna(k) else k for k in key), [0, {(p, i): m.init() for p in range(len(predictions)) for i, m in enumerate(metrics)}])
                own[0] += len(rows)
                y = rows[label].to_numpy()
                for p, i in own[1]:
                    own[1][p, i] = metrics[i].update(own[1][p, i], y, rows[predictions[p]].to_numpy())
            if len(held) * len(predictions) * len(metrics) > HELD:
                yield flushed()
        if held:
            yield flushed()

    def merged(group: pd.DataFrame) -> tuple[int, Any]:
        m = metrics[int(group["_m"].iloc[0])]
        out = m.init()
        for s in group["_state"]:
            out = m.merge(out, pickle.loads(s))
        return int(group["_n"].sum()), out

    def part(group: pd.DataFrame) -> pd.DataFrame:
        n, out = merged(group)
        return pd.DataFrame([(*group[[*by, "_p", "_m"]].iloc[0], n, pickle.dumps(out))], columns=fields)

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        n, out = merged(group)
        first = group.iloc[0]
        m = metrics[int(first["_m"])]
        return pd.DataFrame([(*first[list(by)], predictions[int(first["_p"])], m.name, m.finish(out), n)], columns=[*by, *(c.split()[0] for c in RESULT.split(", "))])

    states = used.mapInPandas(partial, state).withColumn("_part", F.pmod(F.xxhash64("_state", F.spark_partition_id()), F.lit(PARTS)))
    parts = states.groupBy(*by, "_p", "_m", "_part").applyInPandas(part, state)
    out = parts.groupBy(*by, "_p", "_m").applyInPandas(finish, keys + RESULT)
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
