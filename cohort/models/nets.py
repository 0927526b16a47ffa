"""Neural nets with one hidden layer and weight decay, averaged over random starts.
All nets are fitted together, see ``rounds``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .rounds import minimise

#: Weights of fresh nets lie between -START and START.
START = 0.7


def unpack(points: np.ndarray, width: int, size: int, classes: int) -> tuple[np.ndarray, ...]:
    """Weights of some nets: to the hidden layer, its offsets, to the classes, their offsets."""
    cuts = np.cumsum([width * size, size, size * classes])
    a, b, c, d = np.split(points, cuts, axis=1)
    return a.reshape(-1, width, size), b, c.reshape(-1, size, classes), d


def forward(x: np.ndarray, points: np.ndarray, size: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and class probabilities of rows under some nets: (net, row, unit)."""
    a, b, c, d = unpack(points, x.shape[1], size, classes)
    hidden = 0.5 * (1 + np.tanh(0.5 * (x @ a + b[:, None])))
    scores = hidden @ c + d[:, None]
    scores -= scores.max(2, keepdims=True)
    odds = np.exp(scores)
    return hidden, odds / odds.sum(2, keepdims=True)


def loss_and_gradient(x, y, weight, points, size: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows of the weighted cross-entropy and its gradient, for each net."""
    hidden, p = forward(x, points, size, classes)
    c = unpack(points, x.shape[1], size, classes)[2]
    every = np.arange(len(y))
    loss = -(weight * np.log(np.maximum(p[:, every, y], 1e-300))).sum(1)
    p[:, every, y] -= 1
    out = p * weight[:, None]
    back = (out @ c.transpose(0, 2, 1)) * hidden * (1 - hidden)
    parts = [x.T @ back, back.sum(1), hidden.transpose(0, 2, 1) @ out, out.sum(1)]
    return loss, np.concatenate([g.reshape(len(points), -1) for g in parts], 1)


class Nets:
    """Fitted nets; a class's probability is the mean over them."""

    def __init__(self, points: np.ndarray, size: int, classes: int) -> None:
        self.points, self.size, self.classes = points, size, classes

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``__prediction``, the first of the most probable classes."""
        points, size, classes = self.points, self.size, self.classes

        @F.pandas_udf("double")
        def likeliest(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            rows = np.nan_to_num(np.stack(x.to_numpy()))
            mean = sum(forward(rows, points[i : i + 1], size, classes)[1][0] for i in range(len(points)))
            return pd.Series(np.argmax(mean, axis=1).astype("float64"))

        return df.withColumn("__prediction", likeliest(vector_to_array("__x")))


def fit_nets(
    data: DataFrame,
    classes: int,
    size: int = 3,
    repeats: int = 5,
    decay: float = 0.0,
    max_iter: int = 100,
    tol: float = 1e-6,
    seed: int = 1,
) -> Nets:
    """Fit ``repeats`` nets on ``data`` (``__x, __y, __weight``), each from its own start.

    A net's loss is the cross-entropy over all rows (times their weight) plus ``decay`` times the sum of its
    squared weights.
    """

    def start(width: int) -> np.ndarray:
        n = width * size + size + size * classes + classes
        return np.stack([np.random.default_rng([seed, i]).uniform(-START, START, n) for i in range(repeats)])

    def loss(x, y, weight, points, _):
        return loss_and_gradient(x, y, weight, points, size, classes)

    points = minimise(data, start, loss, lambda points: (decay * (points**2).sum(1), 2 * decay * points), max_iter, tol)
    return Nets(points, size, classes)
