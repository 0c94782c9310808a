"""A linear reward on frozen feature vectors, and the choice of the best evaluation step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefdeck.operators.skew import running_total

# Steps per chunk of the running best.
_STEPS = 4096


def linear_reward(features: Column | str, weights: Column | list[float]) -> Column:
    """The dot product, without bias."""
    if isinstance(weights, list):
        weights = F.array(*[F.lit(float(w)) for w in weights])
    features = F.col(features) if isinstance(features, str) else features
    products = F.zip_with(features.cast("array<double>"), weights, lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


@dataclass(frozen=True)
class HeadFit:
    """Weights, and at these weights: the mean Bradley-Terry loss, the whole objective, and the largest
    entry of its gradient. ``steps``: Newton steps taken."""

    weights: list[float]
    bt_loss: float
    objective: float
    gradient: float
    n_pairs: int
    steps: int

    def column(self, features: Column | str) -> Column:
        return linear_reward(features, self.weights)


# Doubles of the sums that a task hands over.
_SUMS = "sums array<double>"


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def _summed(pairs: DataFrame, function: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all pairs of what ``function`` gives for a block of chosen and rejected vectors.

    Each task adds up its blocks; the tasks' arrays are added entry by entry, map-side first, in
    Spark, so the driver gets one array of the size of the result however many tasks there were.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in batches:
            if rows.num_rows:
                part = function(_matrix(rows.column(0), size), _matrix(rows.column(1), size))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    arrays = pairs.mapInArrow(add, _SUMS)
    entries = arrays.select(F.posexplode("sums").alias("entry", "value"))
    rows = entries.groupBy("entry").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max((r["entry"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["entry"]] = r["value"]
    return out


def fit_linear_reward_head(
    pairs: DataFrame,
    chosen: str = "chosen_features",
    rejected: str = "rejected_features",
    reg_coef: float = 0.0,
    ridge: float = 1e-6,
    tolerance: float = 1e-8,
    max_steps: int = 50,
) -> HeadFit:
    """Weights w minimising the mean over pairs of ``-log sigmoid(w (h_chosen - h_rejected))``, plus
    ``reg_coef`` times the mean square of all rewards w h, plus ``ridge`` times the squared weights.

    Newton's method: a step is one pass over the pairs that adds up loss, gradient and Gram matrix
    of the differences (each pair once). The reward penalty is a quadratic form; its matrix takes
    one pass more, before the first step. A step that does not lower the objective is halved. The
    sums have (features)^2 entries, so this is for some thousand features at most. Pairs with a
    vector missing are left out; without pairs the weights are empty. ``ridge`` keeps the weights finite where the pairs
    can be told apart completely.
    """
    sides = pairs.select(
        F.col(chosen).cast("array<double>").alias("chosen"), F.col(rejected).cast("array<double>").alias("rejected")
    ).where("chosen IS NOT NULL AND rejected IS NOT NULL")
    sides = sides.persist()  # read once a step; what is lost with an executor is made again
    try:
        return _newton(sides, reg_coef, ridge, tolerance, max_steps)
    finally:
        sides.unpersist()


def _newton(sides: DataFrame, reg_coef: float, ridge: float, tolerance: float, max_steps: int) -> HeadFit:
    first = sides.select(F.size("chosen").alias("size")).first()
    if first is None:
        return HeadFit([], 0.0, 0.0, 0.0, 0, 0)
    size = int(first["size"])

    penalty = np.zeros((size, size))
    if reg_coef > 0:
        def squares(c: np.ndarray, r: np.ndarray) -> np.ndarray:
            return np.append((c.T @ c + r.T @ r).ravel(), 2 * len(c))

        sums = _summed(sides, squares, size)
        penalty = reg_coef * sums[:-1].reshape(size, size) / sums[-1]
    penalty += ridge * np.eye(size)

    def at(weights: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, int]:
        def parts(c: np.ndarray, r: np.ndarray) -> np.ndarray:
            d = c - r
            margin = d @ weights
            miss = 0.5 * (1.0 - np.tanh(0.5 * margin))  # 1 - sigmoid
            gram = (d * (miss * (1.0 - miss))[:, None]).T @ d
            return np.concatenate([[len(d), np.logaddexp(0.0, -margin).sum()], -(miss @ d), gram.ravel()])

        sums = _summed(sides, parts, size)
        n = int(sums[0])
        loss = sums[1] / n
        gradient = sums[2 : 2 + size] / n + 2 * penalty @ weights
        hessian = sums[2 + size :].reshape(size, size) / n + 2 * penalty
        return loss, loss + weights @ penalty @ weights, gradient, hessian, n

    weights = np.zeros(size)
    loss, objective, gradient, hessian, n = at(weights)
    steps = 0
    while np.abs(gradient).max() > tolerance and steps < max_steps:
        direction = np.linalg.solve(hessian, -gradient)
        share = 1.0
        while True:
            found = at(weights + share * direction)
            if found[1] <= objective + 1e-15 or share < 1e-6:
                break
            share /= 2
        steps += 1
        if found[1] > objective + 1e-15:
            break  # as low as doubles can tell
        weights = weights + share * direction
        loss, objective, gradient, hessian, n = found
    return HeadFit(weights.tolist(), float(loss), float(objective), float(np.abs(gradient).max()), n, steps)


def checkpoint_walk(history: DataFrame, greater_is_better: bool = True) -> DataFrame:
    """``run, step, value`` with ``is_new_best``: strictly better than every earlier step."""
    how = "max" if greater_is_better else "min"
    chunked = history.withColumn("_chunk", F.floor(F.col("step") / F.lit(_STEPS)))
    walked = running_total(
        chunked, F.col("value"), "_best", order=["step"], chunk=["_chunk"], keys=["run"], how=how
    )
    better = F.col("value") > F.col("_best") if greater_is_better else F.col("value") < F.col("_best")
    return walked.withColumn("is_new_best", F.coalesce(better, F.lit(True))).drop("_chunk", "_best")


def best_checkpoint(history: DataFrame, greater_is_better: bool = True) -> DataFrame:
    """Best value per run and the earliest step that reached it."""
    sign = 1.0 if greater_is_better else -1.0
    key = F.struct((F.col("value") * F.lit(sign)).alias("v"), (-F.col("step")).alias("s"))
    return history.groupBy("run").agg(F.max(key).alias("best")).select(
        "run",
        (F.col("best.v") * F.lit(sign)).alias("best_value"),
        (-F.col("best.s")).alias("best_step"),
    )
