"""Many smooth models of one kind, fitted together over the same rows.

In each round every partition of the rows adds up the loss and the gradient of every model at its own trial
point, the sums are added up in two steps, and the driver, which holds nothing but the models' weights, moves
each model on by L-BFGS. Models that have settled drop out; a round is one pass over the rows for all others.
Rows that lie in a single task, as few rows and counted combinations do, are gone through there, without rounds
through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .encoding import WEIGHT

#: Up to so many tasks the driver adds up their sums itself.
DIRECT = 16


def descend(w: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> Generator:
    """L-BFGS with halved steps: yields trial points, is sent (value, gradient), returns the last point kept."""
    value, grad = yield w
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        direction, scales = -grad, []
        for s, y in reversed(pairs):
            scales.append(s @ direction / (s @ y))
            direction = direction - scales[-1] * y
        if pairs:
            s, y = pairs[-1]
            direction = direction * (s @ y / (y @ y))
        for (s, y), k in zip(pairs, reversed(scales)):
            direction = direction + s * (k - y @ direction / (s @ y))
        slope = float(direction @ grad)
        if slope >= 0:
            direction, pairs, slope = -grad, [], -float(grad @ grad)
        step = 1.0 if pairs else min(1.0, 1 / max(float(np.linalg.norm(grad)), 1e-300))
        while True:
            trial = w + step * direction
            new, after = yield trial
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-12:
                return w
        moved, turned = trial - w, after - grad
        if moved @ turned > 1e-12:
            pairs = [*pairs, (moved, turned)][-memory:]
        done = value - new <= tol * (abs(new) + tol)
        w, value, grad = trial, new, after
        if done:
            return w
    return w


def minimise(
    data: DataFrame,
    start: Callable[[int], np.ndarray],
    loss: Callable[..., tuple[np.ndarray, np.ndarray]],
    penalty: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]],
    max_iter: int,
    tol: float,
) -> np.ndarray:
    """The weights (model, weight) that minimise the sum of losses over the rows and the penalty.

    ``data`` has ``__x, __y, __weight``. ``start`` gives the first weights for a number of columns; ``loss`` takes
    columns, classes and weights of some rows, the weights of some models and their numbers, and gives a value and
    gradient for each; so does ``penalty`` for the weights of some models.
    """
    rows = data.select(vector_to_array("__x").alias("x"), F.col("__y").cast("int").alias("y"), F.col(WEIGHT).alias("w"))
    tasks = rows.rdd.getNumPartitions()

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
        return x, batch.column("y").to_numpy(), batch.column("w").to_numpy()

    def settle(begin: np.ndarray, evaluate: Callable) -> np.ndarray:
        searches = [descend(w, max_iter, tol) for w in begin]
        trials, kept = {i: next(search) for i, search in enumerate(searches)}, {}
        while trials:
            names = list(trials)
            points = np.stack([trials[i] for i in names])
            value, grad = evaluate(points, names)
            more, slope = penalty(points)
            for i, v, g in zip(names, value + more, grad + slope):
                try:
                    trials[i] = searches[i].send((float(v), g))
                except StopIteration as stop:
                    kept[i] = stop.value
                    del trials[i]
        return np.stack([kept[i] for i in range(len(begin))])

    if tasks == 1:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y, w = (np.concatenate(c) for c in zip(*[columns(b) for b in batches if b.num_rows]))
            found = settle(start(x.shape[1]), lambda points, names: loss(x, y, w, points, names))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in found], pa.binary())], ["weights"])

        return np.stack([np.frombuffer(r.weights) for r in rows.mapInArrow(alone, "weights binary").collect()])

    rows = rows.persist()

    def evaluate(points: np.ndarray, names: list[int]) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(points), points.shape[1] + 1)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    value, grad = loss(*columns(batch), points, names)
                    total[:, 0] += value
                    total[:, 1:] += grad
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for sums in batch.column(0).to_pylist():
                    total += np.frombuffer(sums).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        sums = rows.mapInArrow(part, "sums binary")
        if tasks > DIRECT:  # a few tasks add up the sums of many before the driver sees them
            sums = sums.repartition(math.isqrt(tasks)).mapInArrow(added, "sums binary")
        total = sum(np.frombuffer(r.sums).reshape(shape) for r in sums.collect())
        return total[:, 0], total[:, 1:]

    try:
        return settle(start(len(rows.first().x)), evaluate)
    finally:
        rows.unpersist()
