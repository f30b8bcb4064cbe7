"""Toxicity categories by a classifier chain: each link is a linear model that also sees the links before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.linear import Rows, best_threshold, fit, logit, sigmoid
from ratewell.llm.text import LOWER, Words, changes, slices, string_buffer

#: Labelled rows that the chain is fitted on, at most; drawn by a hash of the id, so alike at every size.
TRAIN_ROWS = 12_000
FOLDS = 5
#: A word is a feature if this share of the training rows has it (and at least 3 rows), and half at most. As the training
#: rows are bounded, so are the features.
LEAST_SHARE = 0.002
#: Deviations by which a word's count among a link's positives must differ from chance.
LEAST_Z = 3.0
SALT = 0x70C51C

#: Bytes as words see them here: A-Z folded; what is neither a letter nor part of a longer character parts words.
LETTERS = LOWER.copy()
LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def present(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, word hash) once for each distinct word of each row."""
    raw, offsets = string_buffer(batch.column("text"))
    words = Words(LETTERS[raw], offsets)
    order = np.lexsort((words.hash, words.row))
    row, h = words.row[order], words.hash[order]
    first = changes(row, h)
    return row[first], h[first]


@dataclass
class Chain:
    names: list[str]
    vocabulary: np.ndarray  # sorted word hashes
    weights: list[np.ndarray]  # of words, earlier links' logits, intercept
    thresholds: list[float]
    out_of_fold: np.ndarray  # training rows by links

    def scores(self, row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """n x links probabilities, link after link."""
        place = np.searchsorted(self.vocabulary, word)
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == word if len(self.vocabulary) else np.zeros(len(word), bool)
        x = Rows(row[known], place[known], n, len(self.vocabulary))
        out = np.zeros((n, 0))
        for w in self.weights:
            out = np.column_stack([out, sigmoid(x.with_dense(logit(out)).dot(w))])
        return out


def fit_link(x: Rows, y: np.ndarray, l2: float) -> np.ndarray:
    """Weights of a link. Words that these rows don't set apart by LEAST_Z deviations get none; the others are
    penalised the less the more they do."""
    n, share = max(1, x.n), float(y.mean()) if len(y) else 0.0
    count, with_ = np.bincount(x.feature, minlength=x.features), np.bincount(x.feature, y[x.row], minlength=x.features)
    z = (with_ - count * share) / np.sqrt(np.maximum(count * (1 - count / n) * share * (1 - share), 1e-9))
    chosen = np.flatnonzero((np.abs(z) >= LEAST_Z) & (count > 0))
    place = np.full(x.features, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[x.feature] >= 0
    small = fit(Rows(x.row[keep], place[x.feature[keep]], x.n, len(chosen), x.dense), y, np.concatenate([l2 / z[chosen] ** 2, np.full(x.dense.shape[1], 1.0)]))
    w = np.zeros(x.features + x.dense.shape[1] + 1)
    w[chosen] = small[: len(chosen)]
    w[x.features :] = small[len(chosen) :]
    return w


def fit_chain(row: np.ndarray, word: np.ndarray, labels: np.ndarray, fold: np.ndarray, names: list[str], l2: float = 4.0) -> Chain:
    """labels: rows x links of 0/1. A link is trained on the out-of-fold probabilities of the links before it, as
    those are what unseen documents will have; then on all rows for use."""
    n = len(labels)
    every, back, count = np.unique(word, return_inverse=True, return_counts=True)
    frequent = np.flatnonzero((count >= max(3, LEAST_SHARE * n)) & (count <= max(3, n / 2)))
    place = np.full(len(every), -1)
    place[frequent] = np.arange(len(frequent))
    feature = place[back]
    x = Rows(row[feature >= 0], feature[feature >= 0], n, len(frequent))
    seen, weights, thresholds = np.zeros((n, 0)), [], []
    for k in range(labels.shape[1]):
        own, y = x.with_dense(logit(seen)), labels[:, k]
        p = np.zeros(n)
        for f in range(FOLDS):
            if (fold == f).any():
                p[fold == f] = sigmoid(own.take(fold == f).dot(fit_link(own.take(fold != f), y[fold != f], l2)))
        weights.append(fit_link(own, y, l2))
        thresholds.append(best_threshold(p, y))
        seen = np.column_stack([seen, p])
    return Chain(names, every[frequent], weights, thresholds, seen)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Chain:
    """Fits a chain on at most ``rows`` labelled documents. categories: name and SQL condition over the labels' columns,
    in the chain's order. Rows where a condition is null, or the id or text is, don't train.

    Only ids and conditions are sorted for the draw; the drawn ids, bounded by ``rows``, are broadcast to the documents,
    and distinct word hashes of those come to the driver.
    """
    targets = [F.expr(sql).cast("int").alias(f"y{k}") for k, sql in enumerate(categories.values())]
    drawn = labels.select(F.col(id_col).alias("_id"), *targets).dropna().dropDuplicates(["_id"])
    drawn = drawn.orderBy(F.xxhash64(F.lit(SALT), "_id"), "_id").limit(rows)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, word = present(batch)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(word.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), lists], names=[*(c for c in batch.schema.names if c != "text"), "words"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).dropna()
    joined = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select(F.xxhash64(F.lit(SALT), "doc_id").alias("draw"), *(f"y{k}" for k in range(len(categories))), "text")
    table = joined.mapInArrow(words, "draw long, " + "".join(f"y{k} int, " for k in range(len(categories))) + "words array<long>").toArrow().sort_by("draw")
    lists = table.column("words").combine_chunks()
    n = table.num_rows
    sizes = np.asarray(lists.value_lengths()) if n else np.zeros(0, np.int64)
    word = np.asarray(lists.flatten()).view(np.uint64) if n else np.zeros(0, np.uint64)
    y = np.column_stack([table.column(f"y{k}").to_numpy() for k in range(len(categories))]) if n else np.zeros((0, len(categories)))
    fold = np.abs(table.column("draw").to_numpy() // 7) % FOLDS if n else np.zeros(0, np.int64)
    return fit_chain(np.repeat(np.arange(n), sizes), word, y, fold, list(categories))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> and <category> (whether p reaches its threshold) for every document, over its whole text.

    Null or empty text scores by the intercepts. Null ids and repeated rows pass through; nothing is shuffled.
    A chain fitted without labelled rows gives every document 0.5 or what its intercept says, and no category.
    """
    names, cuts = chain.names, chain.thresholds
    schema = "doc_id long" + "".join(f", p_{c} double" for c in names) + "".join(f", {c} boolean" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = chain.scores(*present(batch), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, p.T), *(pa.array(p[:, k] > cuts[k]) for k in range(len(names)))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


#: The categories that the given labels can tell apart. The plain one comes last and sees the other two.
CATEGORIES = {"toxic_prose": "toxic = 1 and quality = 1", "toxic_junk": "toxic = 1 and quality = 0", "toxic": "toxic = 1"}


def toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """CATEGORIES for every document of ``docs``, by a chain fitted on its labelled ones; see score() and train().

    Rows: one per row of ``docs``, repeated rows with equal answers. Null or empty text: what the intercepts say. A
    probability equal to its threshold isn't over it. Texts of any length are read whole. Labels of documents that aren't
    there, and columns of any other name, play no part. Empty documents: empty result; empty labels: no category anywhere.
    """
    return score(docs, train(docs, labels, CATEGORIES))
