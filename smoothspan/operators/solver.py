"""Penalized logistic fits: C * sum of log losses + half the squared coefficients, intercepts free.

Two classes have one score (of the second class), more classes one score each. Small fits run in numpy inside a task, large
ones with MLlib over the whole cluster; both minimize the same objective.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEWTON_MOST = 1500
MAX_ITER = 5000


@dataclass
class Fit:
    classes: list[str]
    intercepts: np.ndarray
    coefficients: np.ndarray
    converged: bool
    iterations: int

    def normal_form(self) -> tuple[np.ndarray, np.ndarray]:
        """One score for each class; with two classes the first has zero parameters."""
        if len(self.classes) == 2 and len(self.intercepts) == 1:
            return np.array([0.0, self.intercepts[0]]), np.vstack([np.zeros_like(self.coefficients[0]), self.coefficients[0]])
        return self.intercepts, self.coefficients


def softmax_rows(scores: np.ndarray) -> np.ndarray:
    """Probabilities of rows of scores; a vector counts as the second of two scores."""
    if scores.ndim == 1:
        scores = np.column_stack([np.zeros_like(scores), scores])
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _loss(theta: np.ndarray, x: np.ndarray, onehot: np.ndarray, c: float) -> float:
    scores = x @ theta.T
    if theta.shape[0] == 1:
        scores = np.column_stack([np.zeros(len(x)), scores[:, 0]])
    top = scores.max(axis=1)
    log_sum = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
    return float(c * (log_sum - (scores * onehot).sum(axis=1)).sum() + 0.5 * (theta[:, 1:] ** 2).sum())


def fit_numpy(x: np.ndarray, y: np.ndarray, classes: list[str], c: float, max_iter: int = MAX_ITER, tol: float = 1e-8) -> Fit:
    """Newton steps with halving, or limited-memory quasi-Newton steps where the Hessian would be large."""
    n, p = x.shape
    k = len(classes)
    rows = 1 if k == 2 else k
    onehot = (y[:, None] == np.array(classes, dtype=object)[None, :]).astype(np.float64)
    full = np.hstack([np.ones((n, 1)), x])
    theta = np.zeros((rows, p + 1))
    free = np.ones(p + 1)
    free[0] = 0.0

    def gradient(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = full @ t.T
        prob = softmax_rows(scores[:, 0] if rows == 1 else scores)
        prob, target = (prob[:, 1:], onehot[:, 1:]) if rows == 1 else (prob, onehot)
        return c * (prob - target).T @ full + t * free, prob

    newton = rows * (p + 1) <= NEWTON_MOST
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    value = _loss(theta, full, onehot, c)
    grad, prob = gradient(theta)
    for iteration in range(1, max_iter + 1):
        if np.abs(grad).max() <= tol * max(1.0, c * n):
            return _finish(classes, theta, True, iteration)
        if newton:
            size = p + 1
            hessian = np.zeros((rows * size, rows * size))
            for a in range(rows):
                for b in range(a, rows):
                    w = c * prob[:, a] * ((a == b) - prob[:, b])
                    block = (full * w[:, None]).T @ full
                    hessian[a * size : (a + 1) * size, b * size : (b + 1) * size] = block
                    hessian[b * size : (b + 1) * size, a * size : (a + 1) * size] = block.T
            hessian += np.diag(np.tile(np.where(free > 0, 1.0, 1e-9 * max(1.0, c * n)), rows))
            step = -np.linalg.solve(hessian, grad.ravel()).reshape(theta.shape)
        else:
            step = -_two_loop(grad.ravel(), pairs).reshape(theta.shape)
        slope, scale = float((grad * step).sum()), 1.0
        while scale > 1e-12:
            new = theta + scale * step
            new_value = _loss(new, full, onehot, c)
            if new_value <= value + 1e-4 * scale * slope + 1e-12 * abs(value):
                break
            scale /= 2
        else:
            return _finish(classes, theta, np.abs(grad).max() <= 1e-4 * max(1.0, c * n), iteration)
        new_grad, prob = gradient(new)
        if not newton:
            s, d = (new - theta).ravel(), (new_grad - grad).ravel()
            if s @ d > 1e-12:
                pairs = [*pairs[-19:], (s, d)]
        theta, value, grad = new, new_value, new_grad
    return _finish(classes, theta, False, max_iter)


def _two_loop(grad: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, steps = grad.copy(), []
    for s, d in reversed(pairs):
        a = (s @ q) / (s @ d)
        steps.append(a)
        q -= a * d
    if pairs:
        s, d = pairs[-1]
        q *= (s @ d) / (d @ d)
    else:
        q /= max(1.0, np.abs(grad).max())
    for (s, d), a in zip(pairs, reversed(steps), strict=True):
        q += (a - (d @ q) / (s @ d)) * s
    return q


def _finish(classes: list[str], theta: np.ndarray, converged: bool, iterations: int) -> Fit:
    intercepts = theta[:, 0].copy()
    if len(intercepts) > 1:
        intercepts -= intercepts.mean()
    return Fit(list(classes), intercepts, theta[:, 1:].copy(), converged, iterations)


def fit_mllib(df: DataFrame, vector: F.Column, target: str, classes: list[str], c: float, max_iter: int = MAX_ITER, tol: float = 1e-10) -> Fit:
    """The same fit with MLlib; ``vector`` is the design as an array column."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    index = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(target)).cast("double") - 1
    rows = df.select(array_to_vector(vector).alias("features"), index.alias("label"))
    n = rows.count()
    family = "binomial" if len(classes) == 2 else "multinomial"
    model = LogisticRegression(
        family=family, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol
    ).fit(rows)
    intercepts, matrix = model.interceptVector.toArray().copy(), model.coefficientMatrix.toArray()
    if len(intercepts) > 1:
        intercepts -= intercepts.mean()
    used = model.summary.totalIterations
    return Fit(list(classes), intercepts, matrix, used < max_iter, used)
