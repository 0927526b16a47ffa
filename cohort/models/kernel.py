"""Support vector machines with a radial kernel and for many classes.

The kernel exp(-gamma |a - b|^2) is the mean of products of random cosines (Fourier features), so a linear
machine on these features is a kernel machine whose fit and prediction are linear in the rows. Many classes are
separated pair by pair; each machine votes, and the first class with most votes wins.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from .rounds import minimise


class FourierFeatures(Transformer):
    """Replace the vector ``__x`` by ``n`` random cosines of it, drawn from a seed.

    Two vectors' products approach the radial kernel of width ``gamma`` (1 / number of columns unless given); the
    error falls with the root of ``n``. The draws depend on the seed and the number of columns alone.
    """

    def __init__(self, gamma: float | None = None, n: int = 200, seed: int = 1) -> None:
        super().__init__()
        self.gamma, self.n, self.draw = gamma, n, seed

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, n, seed = self.gamma, self.n, self.draw

        @F.pandas_udf("array<double>")
        def cosines(x: pd.Series) -> pd.Series:
            if not len(x):
                return x
            rows = np.nan_to_num(np.stack(x.to_numpy()))  # rows with a missing number get no answer anyway
            rng = np.random.default_rng(seed)
            width = np.sqrt(2 * (1 / rows.shape[1] if gamma is None else gamma))
            angle = rows @ (rng.standard_normal((rows.shape[1], n)) * width) + rng.uniform(0, 2 * np.pi, n)
            return pd.Series(list(np.cos(angle) * np.sqrt(2 / n)))

        return df.withColumn("__x", array_to_vector(cosines(vector_to_array("__x"))))


class Machines:
    """One linear machine for each pair of classes; the last weight of each is its offset."""

    def __init__(self, pairs: list[tuple[int, int]], points: np.ndarray, classes: int) -> None:
        self.pairs, self.points, self.classes = pairs, points, classes

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``__prediction``: the class with most votes, the first of equals."""
        pairs, points, classes = self.pairs, self.points, self.classes

        @F.pandas_udf("double")
        def elected(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            side = np.nan_to_num(np.stack(x.to_numpy())) @ points[:, :-1].T + points[:, -1] > 0
            votes = np.zeros((len(x), classes), np.int64)
            for i, (a, b) in enumerate(pairs):
                votes[:, a] += ~side[:, i]
                votes[:, b] += side[:, i]
            return pd.Series(votes.argmax(1).astype("float64"))

        return df.withColumn("__prediction", elected(vector_to_array("__x")))


def hinges(x, y, weight, points, sides, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squared hinge losses and their gradients; ``sides[class, machine]`` is -1, 1 or, not concerned, 0."""
    side = sides[y]
    short = np.maximum(1 - side * (x @ points[:, :-1].T + points[:, -1]), 0) * (side != 0)
    value = cost * (weight[:, None] * short**2).sum(0)
    pull = -2 * cost * weight[:, None] * side * short
    return value, np.concatenate([pull.T @ x, pull.sum(0)[:, None]], 1)


def fit_machines(data: DataFrame, classes: int, cost: float = 1.0, max_iter: int = 100, tol: float = 1e-4) -> Machines:
    """Fit the machines of all pairs together on ``data`` (``__x, __y, __weight``).

    Each minimises half its squared weights plus ``cost`` times the squared hinge loss of the rows of its two
    classes; the offset is free.
    """
    pairs = list(combinations(range(classes), 2))
    sides = np.zeros((classes, len(pairs)))
    for i, (a, b) in enumerate(pairs):
        sides[a, i], sides[b, i] = -1, 1

    def loss(x, y, weight, points, names):
        return hinges(x, y, weight, points, sides[:, names], cost)

    def penalty(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.concatenate([points[:, :-1], np.zeros((len(points), 1))], 1)
        return 0.5 * (own**2).sum(1), own

    points = minimise(data, lambda width: np.zeros((len(pairs), width + 1)), loss, penalty, max_iter, tol)
    return Machines(pairs, points, classes)
