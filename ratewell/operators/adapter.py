"""A small network that turns sensor statistics into token embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

Layers = list[tuple[np.ndarray, np.ndarray]]


def random_layers(inputs: int = 40, tokens: int = 10, width: int = 128, layers: int = 5, seed: int = 0) -> Layers:
    """Weights for ``layers`` dense layers: all but the last as wide as the input, the last tokens * width."""
    rng = np.random.default_rng(seed)
    sizes = [inputs] * layers + [tokens * width]
    return [((rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32), np.zeros(b, np.float32)) for a, b in zip(sizes, sizes[1:], strict=False)]


def forward(x: np.ndarray, layers: Layers, tokens: int) -> np.ndarray:
    """rows x inputs to rows x tokens x width; ReLU after every layer but the last."""
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        if k < len(layers) - 1:
            x = np.maximum(x, 0)
    return x.reshape(len(x), tokens, -1)


def statistics(means: Column, variances: Column) -> Column:
    """The input vector: means, then variances."""
    return F.concat(means, variances).cast("array<float>")


def project(df: DataFrame, column: str, layers: Layers, tokens: int = 10, output: str = "embedding") -> DataFrame:
    """Adds an array<array> of tokens x width, of the weights' type (float or double). The weights, some 60,000 numbers,
    go out with the task."""
    kind = layers[0][0].dtype

    @F.pandas_udf(ArrayType(ArrayType(DoubleType() if kind == np.float64 else FloatType())))
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        out = forward(np.stack(x.to_numpy()).astype(kind), layers, tokens)
        return pd.Series([[list(map(float, t)) for t in row] for row in out])

    return df.withColumn(output, run(F.col(column)))
