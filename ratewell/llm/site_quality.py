"""Quality by document, host and path: a linear document model, and empirical Bayes over sites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.llm.linear import Rows, fit, sigmoid
from ratewell.llm.quality_rules import duplicate_lines, repeated_words
from ratewell.llm.text import Words, slices, string_buffer
from ratewell.llm.texts import ensure_checkpoints

#: Labelled rows that the document model is fitted on, at most; drawn by a hash of the id.
TRAIN_ROWS = 8000
SALT = 0x9A11
FEATURES = ("size", "word length", "letters", "capitals", "digits", "symbols", "bars", "exclamations", "repeats", "same lines", "distinct words", "line length")


def features(batch: pa.RecordBatch) -> np.ndarray:
    """Rows x FEATURES, each bounded or on a log scale; zeros for a text without words."""
    raw, offsets = string_buffer(batch.column("text"))
    words, size = Words(raw, offsets), np.maximum(np.diff(offsets), 1)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / size
    low, up = (raw >= 97) & (raw <= 122), (raw >= 65) & (raw <= 90)
    n, lines = np.maximum(words.count, 1), np.maximum(share(raw == 10) * size + 1, 1)
    data = raw.tobytes()
    order = np.lexsort((words.hash, words.row))
    row, h = words.row[order], words.hash[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    same = np.array([duplicate_lines(data[a:b].decode()) for a, b in zip(offsets, offsets[1:], strict=False)], float)
    out = np.column_stack([
        np.log1p(words.count), np.log1p(size / n), share(low | (raw > 127)), share(up), share((raw >= 48) & (raw <= 57)), share(np.isin(raw, np.frombuffer(b"#*$%&<>", np.uint8))),
        share(raw == 124), share(raw == 33), repeated_words(words) / n, same / lines, np.bincount(row[new], minlength=len(size)) / n, np.log1p(size / lines),
    ])
    out[words.count == 0] = 0
    return out


def expand(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled features and their squares, clipped."""
    z = np.clip((x - middle) / scale, -5, 5)
    return np.column_stack([z, z * z])


def document_model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middle, scale and weights, from at most ``rows`` labelled documents (0.5 for all if there are none)."""
    drawn = labels.select(F.col(id_col).alias("_id"), F.expr(label).cast("int").alias("y")).dropna().dropDuplicates(["_id"])
    drawn = drawn.orderBy(F.xxhash64(F.lit(SALT), "_id"), "_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna().join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    table = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    k = len(FEATURES)
    if not table.num_rows:
        return np.zeros(k), np.ones(k), np.zeros(2 * k + 1)
    x = np.asarray(table.column("x").combine_chunks().flatten()).reshape(-1, k)
    middle, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    dense = expand(x, middle, scale)
    return middle, scale, fit(Rows(np.zeros(0, int), np.zeros(0, int), len(x), 0, dense), table.column("y").to_numpy(), l2=1.0)


def evidence(docs: DataFrame, model: tuple, id_col: str, text_col: str, host: str, path: str) -> DataFrame:
    middle, scale, weights = model
    schema = "doc_id long, host string, path string, p double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = sigmoid(np.column_stack([expand(features(batch), middle, scale), np.ones(batch.num_rows)]) @ weights)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array(np.clip(p, 1e-4, 1 - 1e-4))], names=["doc_id", "host", "path", "p"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, schema)


def strength(groups: DataFrame) -> float:
    """Pseudo-documents of the prior, by moments: how much less groups (n, mean, around) differ than single documents do.

    groups: n documents, their mean, the mean of the level above, and the mean square within. Sparse groups, or groups
    that differ by no more than chance, give a strong prior.
    """
    between = F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")
    r = groups.agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("around")) ** 2).alias("spread"), F.sum("within").alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), between.alias("between")
    ).first()
    if not r or not r.n or r.groups < 2 or r.n <= r.groups or not r.between:
        return 50.0
    inside = max(r.within / (r.n - r.groups), 1e-9)
    return float(min(max(inside / max((r.spread - (r.groups - 1) * inside) / r.between, inside / 1000), 1.0), 1000.0))


def _logit(c: Column) -> Column:
    return F.log(c / (1 - c))


def posterior_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", label: str = "quality = 1", rows: int = TRAIN_ROWS, least: float = 0.5
) -> DataFrame:
    """One row per document: doc_id, p_document, p_host, p_path, p_quality, kept.

    p_document: a linear model over text statistics. p_host: the mean of its host's other documents, shrunk towards the
    mean of all by a number of pseudo-documents estimated from how much hosts differ (``strength``); p_path: likewise of
    the host's path, towards p_host. A document's own evidence is left out of both, so it counts once. p_quality: the
    document's odds times the odds of its path against those of all documents; so a sparse site leaves the document's own
    evidence as it is. kept: p_quality >= ``least``.

    Sites are aggregated with partial sums, and joined back on (host, path) by a join that can split a hot site. Only
    three sums per level reach the driver. Null or empty text has all statistics 0, and texts of any length are read
    whole; a null host or path is a site of its own. Null ids and repeated rows pass through, each counting for its site.
    Extra columns are ignored. Empty table: empty result; without labels p_document is 0.5, and a tie with ``least`` is kept.
    """
    ensure_checkpoints(docs.sparkSession)
    scored = evidence(docs, document_model(docs, labels, id_col, text_col, label, rows), id_col, text_col, host, path).checkpoint()
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum"), F.sum(F.col("p") * F.col("p")).alias("squares")]
    paths = scored.groupBy("host", "path").agg(*sums).checkpoint()
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "sum", "squares"))).checkpoint()
    total = hosts.agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).first()
    mean = F.lit(min(max(float(total["sum"] / total["n"]), 1e-4), 1 - 1e-4) if total["n"] else 0.5)
    level = lambda df, around: df.select("*", (F.col("sum") / F.col("n")).alias("mean"), around.alias("around"), (F.col("squares") - F.col("sum") ** 2 / F.col("n")).alias("within"))
    k = strength(level(hosts, mean))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("sum").alias("host_sum"), (F.col("sum") / F.col("n")).alias("host_mean"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).checkpoint()
    j = strength(level(paths, F.col("host_mean")))
    sites = paths.select("h", F.col("path").alias("q"), F.col("n").alias("path_n"), F.col("sum").alias("path_sum"), "host_n", "host_sum")
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    p = F.col("p")
    out = out.withColumn("p_host", (F.col("host_sum") - p + k * mean) / (F.col("host_n") - 1 + k))
    out = out.withColumn("p_path", (F.col("path_sum") - p + j * F.col("p_host")) / (F.col("path_n") - 1 + j))
    out = out.withColumn("p_quality", 1 / (1 + F.exp(-(_logit(p) + _logit(F.col("p_path")) - _logit(mean)))))
    return out.select("doc_id", p.alias("p_document"), "p_host", "p_path", "p_quality", (F.col("p_quality") >= least).alias("kept"))
