"""Multinomial logistic regression for all folds at once: one scan of the data per step.

Each model is a coroutine that asks for the loss and its derivatives at a point. A pass answers all of them together, so five
folds cost one scan per step; a model that has converged no longer takes part. Models of up to NEWTON parameters take Newton
steps (a handful of scans), larger ones limited-memory quasi-Newton steps.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Generator, Sequence

import numpy as np

from foldwright.operators.passes import Block, Model, Packed, summed

#: Largest number of parameters whose second derivatives are summed.
NEWTON = 512
_MEMORY, _ARMIJO, _HALVINGS = 10, 1e-4, 40
Minimiser = Generator[np.ndarray, tuple[float, np.ndarray, np.ndarray], np.ndarray]


def newton(x: np.ndarray, tol: float, most: int) -> Minimiser:
    """Yields points, is sent (loss, gradient, Hessian) at each, returns the minimum of a convex function."""
    loss, grad, hessian = yield x
    for _ in range(most):
        if np.abs(grad).max() <= tol:
            break
        # Least squares: a constant added to all intercepts changes nothing, so the matrix has a null direction.
        way = np.linalg.lstsq(hessian, grad, rcond=1e-12)[0]
        slope, size = -(grad @ way), 1.0
        for _ in range(_HALVINGS):
            there = x - size * way
            new = yield there
            if new[0] <= loss + _ARMIJO * size * slope:
                break
            size /= 2
        else:
            break  # no descent left in double precision
        x, (loss, grad, hessian) = there, new
    return x


def quasi_newton(x: np.ndarray, tol: float, most: int) -> Minimiser:
    """As newton(), without using the Hessian. Ends when the largest gradient entry is below tol, or after `most` steps."""
    loss, grad, _ = yield x
    pairs: deque = deque(maxlen=_MEMORY)
    for _ in range(most):
        if np.abs(grad).max() <= tol:
            break
        way, factors = grad.copy(), []
        for s, y, rho in reversed(pairs):
            factors.append(rho * (s @ way))
            way -= factors[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(factors)):
            way += (a - rho * (y @ way)) * s
        slope = -(grad @ way)
        if slope >= 0:  # rounding has spoilt the memory
            pairs.clear()
            way, slope = grad, -(grad @ grad)
        size = 1.0 if pairs else min(1.0, 1.0 / np.abs(grad).sum())
        for _ in range(_HALVINGS):
            there = x - size * way
            new_loss, new_grad, _ = yield there
            if new_loss <= loss + _ARMIJO * size * slope:
                break
            size /= 2
        else:
            break  # no descent left in double precision
        s, y = there - x, new_grad - grad
        if s @ y > 1e-12 * (y @ y):
            pairs.append((s, y, 1.0 / (s @ y)))
        x, loss, grad = there, new_loss, new_grad
    return x


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _second(x: np.ndarray, p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Second derivatives of the summed loss; parameters in the order (row of the coefficients, class)."""
    (n, d), k = x.shape, p.shape[1]
    out = np.empty((d, k, d, k))
    for a in range(k):
        for b in range(a + 1):
            out[:, a, :, b] = out[:, b, :, a] = x.T @ (x * (w * p[:, a] * ((a == b) - p[:, b]))[:, None])
    return out.reshape(d * k, d * k)


def _losses(models: Sequence[Model], k: int, second: bool):
    """Per asked model the weighted log loss and its derivatives over the rows that the model may see."""
    def work(block: Block, state) -> tuple:
        points, weights, present = state
        size = (block.x.shape[1] + 1) * k
        loss, grad, hessian = np.zeros(len(models)), np.zeros((len(models), size // k, k)), np.zeros((len(models), size, size) if second else 1)
        for i, m in enumerate(models):
            if points[i] is None:
                continue
            rows = block.seen_by(m)
            x, y = block.x[rows], block.y[rows]
            w = weights[i][y]
            z = x @ points[i][:-1] + points[i][-1] + np.where(present[i], 0.0, -np.inf)
            p = softmax(z) if len(y) else z
            at = np.arange(len(y))
            loss[i] = -(w * np.log(np.maximum(p[at, y], 1e-300))).sum()
            if second:
                hessian[i] = _second(np.hstack([x, np.ones((len(x), 1))]), p, w)
            p[at, y] -= 1.0
            p *= w[:, None]
            grad[i, :-1], grad[i, -1] = x.T @ p, p.sum(axis=0)
        return loss, grad, hessian

    return work


def fit(packed: Packed, models: Sequence[Model], k: int, balanced: bool, c: float = 1.0, most: int = 3000, tol: float = 1e-6) -> dict[Model, tuple]:
    """(coefficients with the intercept as last row, classes present) per model; minimises c * sum of losses + |w|^2 / 2."""
    weights, shape = packed.weights(models, k, balanced), (packed.dim + 1, k)
    counts = np.array([packed.class_counts(m, k) for m in models])
    present, total = counts > 0, (weights * counts).sum(axis=1)
    second = shape[0] * k <= NEWTON
    runs = [(newton if second else quasi_newton)(np.zeros(shape).ravel(), tol, most) for _ in models]
    points, found = [next(r).reshape(shape) if n else None for r, n in zip(runs, total)], {}
    work = _losses(list(models), k, second)
    while any(p is not None for p in points):
        losses, grads, hessians = summed(packed.blocks, work, (points, weights, present))
        for i, p in enumerate(points):
            if p is None:
                continue
            ridge = np.full(shape, 1.0 / (c * total[i]))
            ridge[-1] = 0.0  # intercepts are free
            loss, grad = losses[i] / total[i] + 0.5 * (ridge * p * p).sum(), (grads[i] / total[i] + ridge * p).ravel()
            try:
                points[i] = runs[i].send((loss, grad, hessians[i] / total[i] + np.diag(ridge.ravel()) if second else None)).reshape(shape)
            except StopIteration as done:
                points[i], found[models[i]] = None, (done.value.reshape(shape), present[i])
    return found


def probabilities(x: np.ndarray, model: tuple, _=None) -> np.ndarray:
    w, present = model
    return softmax(x @ w[:-1] + w[-1] + np.where(present, 0.0, -np.inf))
