"""Metrics that merge, against the same metrics over whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.operators import bootstrap, merging
from ratewell.operators.checks import ConstraintError

SPREAD = merging.Merging("largest gap", lambda: 0.0, lambda s, a, b: max(s, float(np.abs(a - b).max())), max, lambda s: s)


def test_merged_metrics(spark, monkeypatch):
    monkeypatch.setattr(merging, "HELD", 3)
    rng = np.random.default_rng(7)
    g = rng.choice(["hot", "hot", "hot", "cold"], 900)
    y, p, q = rng.integers(0, 2, 900), rng.integers(1, 6, 900), rng.integers(0, 3, 900)
    rows = [(None if k == "cold" else k, int(a), int(b), int(c)) for k, a, b, c in zip(g, y, p, q, strict=True)] + [("hot", None, 1, 1), ("one class", 1, 2, 2)]
    df = spark.createDataFrame(rows, "g string, y int, p int, q int").repartition(9)
    got = {(r.g, r.prediction_name, r.metric_name): (r.value, r.n) for r in merging.merged_metrics(df, ["g"], "y", ["p", "q"], [merging.AC2, merging.AUROC, SPREAD]).collect()}
    assert len(got) == 3 * 2 * 3
    for key, name in (("hot", "hot"), ("cold", None)):
        own = g == key
        for c, x in (("p", p), ("q", q)):
            a, b = y[own], x[own]
            area = np.mean([(s > t) + 0.5 * (s == t) for s in b[a == 1] for t in b[a == 0]])
            want = {"gwet_ac2": bootstrap.ac2_metric(a, b), "auroc": area, "largest gap": np.abs(a - b).max()}
            for m, value in want.items():
                assert got[name, c, m] == (pytest.approx(value), own.sum())
    assert got["one class", "p", "auroc"] == (None, 1)
    whole = merging.merged_metrics(df, [], "y", ["p"], [SPREAD], mask=F.col("p") < 4).collect()
    assert [(r.value, r.n) for r in whole] == [(3.0, sum(p < 4) + 1)]
    with pytest.raises(ConstraintError):
        merging.merged_metrics(df, ["g"], "y", ["p"], [SPREAD, SPREAD])
