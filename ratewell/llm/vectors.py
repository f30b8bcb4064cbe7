"""Vectors as whole numbers: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled entries stay below this, so that squared distances of up to 64 entries fit a long.
LARGEST = 2**27


def finite(vec: Column) -> Column:
    """True where the vector is there and all its entries are numbers; an empty vector passes."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def whole(vec: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * entry) + shift as longs; an entry that leaves the range of exact sums is an error, never a wrong result."""

    def one(c: Column) -> Column:
        x = c.cast("double") * scale
        far = F.raise_error(F.concat(F.lit(f"an entry times {scale} is beyond {LARGEST}: "), c.cast("string"))).cast("bigint")
        return F.when(F.abs(x) < LARGEST, F.floor(x) + shift).otherwise(far)

    return F.transform(vec, one)


def integers(df: DataFrame, id_col: str, vec_col: str, scale: int, shift: int = 0, dims: int | None = None) -> DataFrame:
    """(vec_id, x): finite vectors (of ``dims`` entries, if given) as longs; the columns' names may hold any characters."""
    vec, quoted = F.col(f"`{vec_col}`"), F.col(f"`{id_col}`")
    good = finite(vec) if dims is None else finite(vec) & (F.size(vec) == dims)
    return df.filter(good).select(quoted.cast("bigint").alias("vec_id"), whole(vec, scale, shift).alias("x"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A list column of equal lengths as rows x dims."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``, and one of what is left."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while size + batch.num_rows >= rows:
            kept.append(batch.slice(0, rows - size))
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            batch, kept, size = batch.slice(rows - size), [], 0
        if batch.num_rows:
            kept.append(batch)
            size += batch.num_rows
    if size:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
