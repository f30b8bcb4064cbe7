"""Centroid clustering and whitening against plain versions on the same vectors."""

import hashlib
import math

import numpy as np
import pytest

from ratewell.llm import centroids, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, `x.y` string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "a") for i, v in rows], SCHEMA).repartition(parts)


def vectors(n, dims=64, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32) * 0.4
    return [(i, v.tolist()) for i, v in enumerate(x)]


def plain_clusters(rows, k=16, rounds=3, scale=64, dims=64):
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (i is None if (i := r[0]) is None else False, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [c for _, c in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centres = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centres)]
    out = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = {}
    for _, c, d in out:
        inertia[c] = inertia.get(c, 0) + d
    return sorted((i if i is not None else -1, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in out)


def found_clusters(df, **how):
    out = centroids.clusters(df, **how)
    return sorted((r.vec_id if r.vec_id is not None else -1, *r[1:]) for r in out.collect())


def test_clusters_equal_plain_ones(spark):
    rows = vectors(700)
    assert found_clusters(frame(spark, rows)) == plain_clusters(rows)


def test_clusters_with_ties_repeats_and_bad_rows(spark):
    grid = [(i, [float((i >> j) & 1) if j < 5 else 0.0 for j in range(64)]) for i in range(200)]
    bad = [(900, None), (901, [0.1] * 63), (902, [None] + [0.0] * 63), (903, [float("nan")] + [0.0] * 63), (904, [float("inf")] * 64), (905, [])]
    same = [(7, [0.5] * 64)] * 150 + [(None, [0.25] * 64)]
    rows = grid + bad + same
    assert found_clusters(frame(spark, rows)) == plain_clusters(rows)


def test_clusters_of_few_rows_and_none(spark):
    rows = vectors(5)
    assert found_clusters(frame(spark, rows)) == plain_clusters(rows)
    assert found_clusters(frame(spark, [(1, None)])) == []
    assert centroids.clusters(frame(spark, [])).columns == [c.split()[0] for c in centroids.RESULT.split(", ")]


def test_entries_out_of_range_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.clusters(frame(spark, [(1, [1e30] * 64)])).collect()


def test_filtering_prunes_whole_nodes_and_stays_exact():
    rng = np.random.default_rng(0)
    centres = rng.integers(-500, 500, (6, 4)) * 10
    points = (centres[rng.integers(0, 6, 4000)] + rng.integers(-30, 31, (4000, 4))).astype(np.int64)
    tree, order = centroids.build(points)
    cluster, far = centroids.placed(tree, centres)
    plain = ((points[order][:, None] - centres[None]) ** 2).sum(2)
    assert (cluster == plain.argmin(1)).all() and (far == plain.min(1)).all()
    nodes, _, leaves, _ = centroids.filtered(tree, centres)
    assert tree.sizes[nodes].sum() > 3500 and tree.sizes[nodes].sum() + tree.sizes[leaves].sum() == 4000
    counts, sums = centroids.moved(tree, centres)
    assert (counts == np.bincount(plain.argmin(1), minlength=6)).all()
    assert (sums == np.stack([points[order][plain.argmin(1) == j].sum(0) for j in range(6)])).all()


def test_large_entries_are_exact():
    points, centres = np.array([[2**26, 1, -(2**26)]], np.int64), np.array([[2**26 - 1, 0, -(2**26)], [-(2**26), 5, 3]], np.int64)
    assert centroids.distances(points, centres).tolist() == [[2, 2**54 + 16 + (2**26 + 3) ** 2]]


def test_jacobi_keeps_small_eigenvalues():
    values, _ = whitening.jacobi([[1.0, 1e-8], [1e-8, 1e-15]])
    assert abs(values[1] / 9e-16 - 1) < 1e-12  # the determinant over the other eigenvalue
    rng = np.random.default_rng(1)
    b = rng.normal(size=(30, 12))
    b = b.T @ b
    values, axes = whitening.jacobi(b)
    assert np.allclose(values, np.linalg.eigvalsh(b)[::-1], rtol=1e-12)
    assert np.allclose(axes.T @ axes, np.eye(12), atol=1e-13) and np.allclose(axes @ np.diag(values) @ axes.T, b, rtol=1e-11)


def test_whitening_equals_plain_one(spark):
    rows = vectors(600, dims=12) + [(900, None), (901, [None] + [0.0] * 11), (902, [float("nan")] * 12), (903, [0.5] * 11)]
    out = whitening.whitening(frame(spark, rows)).toPandas()
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows[:600]])
    n, sums = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(out) == 8 * 600 and set(out.n) == {600} and sorted(out.component.unique()) == list(range(1, 9))
    assert (out.groupby("vec_id").deviation.first() == ((n * x - sums) ** 2).sum(1)).all()
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (x - sums / n) @ axes[:, :8] / np.sqrt(values[:8])
    sign = np.sign((w * want).sum(0))
    assert np.allclose(w, want * sign, atol=1e-9)
    assert np.allclose(out.groupby("component").explained.first(), values[:8] / values.sum(), rtol=1e-9)
    assert out.identity_error.max() < 1e-9 and out.identity_error.nunique() == 1


def test_whitening_of_odd_tables(spark):
    assert whitening.whitening(frame(spark, [])).count() == 0
    assert whitening.whitening(frame(spark, [(1, []), (2, None)])).count() == 0
    one = whitening.whitening(frame(spark, [(1, [0.5, 0.25])] * 3 + [(None, [0.5, 0.25])])).collect()
    assert len(one) == 8 and all(r.whitened is None and r.deviation == 0 and r.identity_error == 0 for r in one)
    line = whitening.whitening(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert len(line) == 10 and all((r.whitened is None) == (r.component == 2) for r in line)
    assert all(r.identity_error < 1e-9 and abs(r.explained - (2 - r.component)) < 1e-9 for r in line)


def test_deviation_beyond_longs():
    x = np.full((2, 3), 2**40, np.int64)
    d = whitening.centred(x, 2**30, [0, 0, 0])
    assert d[0, 0] == 2**70 and whitening.deviations(d) == [None, None]
    assert whitening.deviations(whitening.centred(x, 2, [2**41, 2**41, 2**41 - 3])) == [9, 9]
