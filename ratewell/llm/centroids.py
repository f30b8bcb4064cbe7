"""Centroid clustering by filtering: kd-trees hold counts, sums and boxes, and whole nodes go to one centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.texts import ensure_checkpoints, stored
from ratewell.llm.vectors import gathered, integers, matrix

#: Vectors of one tree, and of a leaf at most. A task that reads millions of vectors builds many trees.
TREE, LEAF = 4096, 64
#: Below this, sums of squares are exact in doubles, so that leaves are resolved by a product of matrices.
EXACT = 2**22

TREES = "ids array<bigint>, points binary, sizes binary, low binary, high binary, sums binary"
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


@dataclass
class Tree:
    """Nodes of a heap (children of i: 2i + 1 and 2i + 2): how many points, their sums and box. Points lie in leaf order."""

    points: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @property
    def inner(self) -> int:
        """Number of inner nodes; the others are leaves."""
        return len(self.sizes) // 2

    def first(self) -> np.ndarray:
        """Place of the first point of each node."""
        out = np.zeros(len(self.sizes), np.int64)
        for i in range(self.inner):
            out[2 * i + 1], out[2 * i + 2] = out[i], out[i] + self.sizes[2 * i + 1]
        return out


def build(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of some points (rows x dims, whole numbers), and their order in it. Nodes are halved at the median of their
    widest side; equal points may fall on both sides."""
    n, dims = points.shape
    levels = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    nodes = 2 ** (levels + 1) - 1
    sizes, sums = np.zeros(nodes, np.int64), np.zeros((nodes, dims), np.int64)
    low, high = np.zeros((nodes, dims), np.int64), np.zeros((nodes, dims), np.int64)
    members: list = [None] * nodes
    members[0] = np.arange(n)
    for i in range(nodes):
        own = members[i]
        x = points[own]
        sizes[i], sums[i], low[i], high[i] = len(own), x.sum(0), x.min(0), x.max(0)
        if i < nodes // 2:
            half = len(own) // 2
            order = np.argpartition(x[:, int(np.argmax(high[i] - low[i]))], half)
            members[2 * i + 1], members[2 * i + 2], members[i] = own[order[:half]], own[order[half:]], None
    order = np.concatenate(members[nodes // 2 :])
    return Tree(points[order], sizes, low, high, sums), order


def filtered(tree: Tree, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, their one centroid, leaves, masks of the centroids that are left for them), from the root down.

    A centroid is dominated where, at the corner of the box that suits it most, the candidate nearest to the box's middle
    is strictly nearer; it then is nowhere nearest in the box. Equal distances dominate nothing, so ties reach the leaves.
    """
    whole, single, leaves, masks = [], [], [], []
    node, mask = np.zeros(1, np.int64), np.ones((1, len(centres)), bool)
    while len(node):
        low, high = tree.low[node], tree.high[node]
        middle = ((2 * centres[None] - (low + high)[:, None]) ** 2).sum(2)
        best = np.where(mask, middle, np.iinfo(np.int64).max).argmin(1)
        way = centres[None] - centres[best][:, None]
        corner = np.where(way > 0, high[:, None], low[:, None])
        beaten = (way * (centres[None] + centres[best][:, None] - 2 * corner)).sum(2) > 0
        mask = mask & ~beaten
        one, last = mask.sum(1) == 1, node >= tree.inner
        whole.append(node[one])
        single.append(mask[one].argmax(1))
        leaves.append(node[~one & last])
        masks.append(mask[~one & last])
        down = ~one & ~last
        node, mask = np.concatenate([2 * node[down] + 1, 2 * node[down] + 2]), np.concatenate([mask[down], mask[down]])
    return np.concatenate(whole), np.concatenate(single), np.concatenate(leaves), np.concatenate(masks)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points x centroids, exact."""
    if max(np.abs(points).max(initial=0), np.abs(centres).max(initial=0)) * np.sqrt(points.shape[1] / 64) < EXACT:
        x, c = points.astype(float), centres.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centres], 1)


def _places(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the points of some nodes, and which of the nodes each is in."""
    sizes, first = tree.sizes[nodes], tree.first()[nodes]
    of = np.repeat(np.arange(len(nodes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of], of


def _resolved(tree: Tree, leaves: np.ndarray, masks: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, centroid, distance) of each point of the leaves; of equally near centroids the first."""
    at, of = _places(tree, leaves)
    far = np.where(masks[of], distances(tree.points[at], centres), np.iinfo(np.int64).max)
    cluster = far.argmin(1)
    return at, cluster, far[np.arange(len(at)), cluster]


def moved(tree: Tree, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the tree's points are nearest to each centroid, and their sums; nodes that go whole cost one addition."""
    counts, sums = np.zeros(len(centres), np.int64), np.zeros_like(centres)
    nodes, single, leaves, masks = filtered(tree, centres)
    np.add.at(counts, single, tree.sizes[nodes])
    np.add.at(sums, single, tree.sums[nodes])
    if len(leaves):
        at, cluster, _ = _resolved(tree, leaves, masks, centres)
        counts += np.bincount(cluster, minlength=len(centres))
        np.add.at(sums, cluster, tree.points[at])
    return counts, sums


def placed(tree: Tree, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and distance of each point, in the tree's order."""
    cluster, far = np.zeros(len(tree.points), np.int64), np.zeros(len(tree.points), np.int64)
    nodes, single, leaves, masks = filtered(tree, centres)
    at, of = _places(tree, nodes)
    cluster[at] = single[of]
    for c in np.unique(single):
        own = at[single[of] == c]
        far[own] = ((tree.points[own] - centres[c]) ** 2).sum(1)
    if len(leaves):
        at, near, apart = _resolved(tree, leaves, masks, centres)
        cluster[at], far[at] = near, apart
    return cluster, far


def forest(vectors: DataFrame, dims: int) -> DataFrame:
    """A row for each tree, of what integers() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, TREE):
            tree, order = build(matrix(batch.column("x"), dims).astype(np.int64))
            ids = batch.column("vec_id").take(pa.array(order))
            one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            parts = (tree.points.astype(np.int32), tree.sizes, tree.low.astype(np.int32), tree.high.astype(np.int32), tree.sums)
            yield pa.RecordBatch.from_arrays([one, *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["ids", "points", "sizes", "low", "high", "sums"])

    return vectors.mapInArrow(run, TREES)


def _trees(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[Tree, pa.Array]]:
    for i in range(batch.num_rows):
        points, low, high = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32).reshape(-1, dims).astype(np.int64) for c in ("points", "low", "high"))
        sizes, sums = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("sizes", "sums"))
        yield Tree(points, sizes, low, high, sums.reshape(-1, dims)), batch.column("ids")[i].values


def one_round(trees: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of their vectors; a centroid without vectors stays. What comes to
    the driver is a sum for each centroid and entry, whatever the number of vectors."""
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for tree, _ in _trees(batch, dims):
                n, s = moved(tree, centres)
                counts += n
                sums += s
        cluster, entry = np.divmod(np.arange(k * dims), dims)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (cluster, entry, counts[cluster], sums.ravel()))], names=["cluster", "entry", "n", "total"])

    parts = trees.mapInArrow(run, "cluster bigint, entry bigint, n bigint, total bigint")
    out = centres.copy()
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    for r in parts.groupBy("cluster", "entry").agg(exact("n").alias("n"), exact("total").alias("total")).filter("n > 0").collect():
        out[r.cluster, r.entry] = int(r.total) // int(r.n)
    return out


def starts(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors whose ids hash lowest, in that order; rows without an id come last, and of one id the lower vector first."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.x for r in vectors.orderBy(F.asc_nulls_last(key), "x").limit(k).collect()], np.int64)


def clusters(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors with ``dims`` finite entries are turned into whole numbers, floor(scale * entry); others are left out. The k
    vectors whose hashed ids come first are the centroids to begin with. Each of ``rounds`` rounds gives every vector to the
    nearest (of equals the lowest number) and replaces a centroid by the floor of its vectors' mean. All in whole numbers,
    so that any partitioning gives the same result.

    Trees are built once, of TREE vectors each, and written; a round reads them and moves k sums per task. Fewer vectors
    than k: as many centroids. An empty table: no rows. Rows that repeat an id are vectors of their own; a null id stays
    null. Extra columns are ignored, whatever their names. Entries of 2**27 / scale and more are an error, as their
    distances don't fit a long. Needs spark.checkpoint.dir.
    """
    ensure_checkpoints(df.sparkSession)
    vectors = integers(df, id_col, vec_col, scale, dims=dims)
    centres = starts(vectors, k)
    if not len(centres):
        return df.sparkSession.createDataFrame([], RESULT)
    trees = stored(forest(vectors, dims))
    for _ in range(rounds):
        centres = one_round(trees, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, ids in _trees(batch, dims):
                cluster, far = placed(tree, centres)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    assigned = stored(trees.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"))
    inertia = [(r.cluster, r.inertia) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()]  # k rows at most
    total = sum(x for _, x in inertia)
    named = [(c, x, total, hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, x in inertia]
    report = df.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(report), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
