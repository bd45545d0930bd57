"""Multinomial logistic regression over sparse blocks, its rows spread over the cluster.

The coefficients, one row for each feature, are on the driver and on every executor, as in
Spark's own regression.  Unlike there the features aren't scaled to unit deviation: the
penalty then weighs rare features a million times more than frequent ones, and a hundred
iterations don't reach the optimum.  The curvature of every feature, its penalty included,
scales the steps instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block is some rows as bytes: entries of every row, their features and values, and label and weight of the row.
BLOCK = {"sizes": "int32", "features": "int32", "values": "float64", "labels": "int32", "weights": "float64"}
BLOCK_SCHEMA = ", ".join(f"{c} binary" for c in BLOCK)
#: Pairs of steps kept, in single precision; they shape a direction only.
MEMORY = 10
HALVINGS = 30


def block(*arrays: np.ndarray) -> pa.RecordBatch:
    """One block as a row of ``BLOCK_SCHEMA``."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a, t).tobytes()], pa.binary()) for a, t in zip(arrays, BLOCK.values(), strict=True)], names=list(BLOCK))


def logits(sizes: np.ndarray, features: np.ndarray, values: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Row sums of values times coefficients; the last row of ``coefficients`` is the intercept."""
    out = np.tile(coefficients[-1], (len(sizes), 1))
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] += np.add.reduceat(coefficients[features] * values[:, None], starts, axis=0)
    return out


def fit(blocks: DataFrame, size: int, n_classes: int, penalty: float, max_iter: int, tol: float = 1e-6) -> np.ndarray:
    """Coefficients of ``size`` features and an intercept, by classes, that minimise the mean loss plus ``penalty`` / 2 times their squares.

    Intercepts are free.  A class without rows is never predicted.  Iterations end once one improves the objective by
    less than ``tol`` of it, or after ``max_iter``.  Every task sends one gradient to the driver, of as many tasks as there are cores.
    """
    sc = blocks.sparkSession.sparkContext
    tasks = blocks.coalesce(sc.defaultParallelism)

    def summed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: tuple[int, ...]) -> tuple[float, np.ndarray]:
        sums = np.zeros(shape)
        found = tasks.mapInArrow(task, "loss double, sums binary").toArrow()
        for part in found["sums"]:
            sums += np.frombuffer(part.as_buffer()).reshape(shape)
        return sum(found["loss"].to_pylist()), sums

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + n_classes)
        for sizes, features, values, labels, weights in _blocks(batches):
            sums[:size] += np.bincount(features, np.repeat(weights, sizes) * values * values, size)
            sums[size:] += np.bincount(labels, weights, n_classes)
        yield _sums(0.0, sums)

    _, sums = summed(totals, (size + n_classes,))
    counts, n = sums[size:], sums[size:].sum()
    if not n:
        raise ValueError("there are no rows to fit")
    seen = counts > 0
    share = counts / n
    spread = (share * (1 - share)).max()
    curvature = np.append(penalty + spread * sums[:size] / n, max(spread, penalty))[:, None]

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        sent = sc.broadcast(x)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, loss, sums = sent.value, 0.0, np.zeros((size + 1, n_classes))
            for sizes, features, values, labels, weights in _blocks(batches):
                z = np.where(seen, logits(sizes, features, values, w), -np.inf)
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                total = p.sum(axis=1)
                rows = np.arange(len(sizes))
                loss += float(weights @ (np.log(total) - z[rows, labels]))
                p /= total[:, None]
                p[rows, labels] -= 1
                p *= weights[:, None]
                sums[-1] += p.sum(axis=0)
                for c in np.flatnonzero(seen):
                    sums[:-1, c] += np.bincount(features, np.repeat(p[:, c], sizes) * values, size)
            yield _sums(loss, sums)

        loss, gradient = summed(task, (size + 1, n_classes))
        sent.destroy()
        gradient /= n
        gradient[:-1] += penalty * x[:-1]
        return loss / n + penalty / 2 * float(np.vdot(x[:-1], x[:-1])), gradient

    x = np.zeros((size + 1, n_classes))
    x[-1, seen] = np.log(share[seen])
    x[-1, seen] -= x[-1, seen].mean()
    x = minimised(objective, x, curvature, max_iter, tol) if seen.sum() > 1 else x
    x[-1, ~seen] = -np.inf
    return x


def minimised(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, curvature: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Where a convex ``objective`` (value, gradient) is least: L-BFGS whose first guess of the Hessian is ``curvature``."""
    value, gradient = objective(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        step = -gradient
        back = []
        for s, y, rho in reversed(past):
            a = rho * float(np.vdot(s, step))
            step -= a * y
            back.append(a)
        step /= curvature
        if past:
            s, y, rho = past[-1]
            step /= rho * float(np.vdot(y, y / curvature))
        for (s, y, rho), a in zip(past, reversed(back), strict=True):
            step += (a - rho * float(np.vdot(y, step))) * s
        slope = float(np.vdot(gradient, step))
        if slope >= 0:
            break
        length = 1.0
        for _ in range(HALVINGS):
            after, turned = objective(x + length * step)
            if after <= value + 1e-4 * length * slope:
                break
            length *= min(0.5, max(0.1, -slope * length / (2 * (after - value - slope * length))))
        else:
            break
        step *= length
        x, gained = x + step, value - after
        s, y = step.astype(np.float32), (turned - gradient).astype(np.float32)
        value, gradient = after, turned
        if (sy := float(np.vdot(s, y))) > 0:
            past = [*past[-MEMORY + 1 :], (s, y, 1 / sy)]
        if gained <= tol * abs(value):
            break
    return x


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in BLOCK.items()]


def _sums(loss: float, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([sums.tobytes()], pa.binary())], names=["loss", "sums"])
