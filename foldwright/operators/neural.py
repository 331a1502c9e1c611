"""A network with one layer of rectified units, trained for all folds at once: one scan per epoch.

In an epoch every task starts from the shared parameters and takes Adam steps over its own rows in small batches, in an order
drawn from (seed, epoch, task); the results are averaged by the rows they come from. With one task that is plain mini-batch
training; with more, tasks agree once per epoch, so an epoch costs one scan and one exchange of the parameters however many
batches it has (agreeing after every batch would exchange them a hundred times as often). The number of tasks follows the
data's size alone. A single task has nobody to agree with: it takes as many epochs as fit SLICE_SECONDS before it hands the
parameters back, with the same result.

Early stopping: a share of the rows, by a seeded hash of the key, is kept out of training. Their loss is taken at the start of
the next scan; after `patience` epochs without a loss lower by `tol` a model stops, and its best parameters are kept.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwright.operators.linear import softmax
from foldwright.operators.passes import TASK_ENTRIES, Block, Model, Packed

# Settings of the head and of its optimiser.
HIDDEN, EPOCHS, BATCH, RATE, PENALTY, HELD_OUT, PATIENCE, TOL = 512, 400, 200, 1e-3, 1e-4, 0.1, 10, 1e-4
_BETA1, _BETA2, _EPS = 0.9, 0.999, 1e-8
#: Length of a task that takes several epochs.
SLICE_SECONDS = 5.0


@dataclass
class Network:
    """Flat parameters with Adam's moments and step count; best: parameters and loss of the best epoch."""
    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    best: np.ndarray | None = None
    best_loss: float = np.inf
    waited: int = 0


def aside(held_out: float = HELD_OUT, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(10_000)) < int(held_out * 10_000)


def tasks_for(rows: int, dim: int) -> int:
    return max(1, -(-rows * (dim + 16) // TASK_ENTRIES))


def shapes(dim: int, hidden: int, k: int) -> list[tuple[int, ...]]:
    return [(dim, hidden), (hidden,), (hidden, k), (k,)]


def unflatten(theta: np.ndarray, dim: int, hidden: int, k: int) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(dim, hidden, k):
        n = int(np.prod(s))
        out.append(theta[at:at + n].reshape(s))
        at += n
    return out


def start(dim: int, hidden: int, k: int, seed: int) -> Network:
    """Uniform weights in +-sqrt(6 / (inputs + outputs))."""
    rng = np.random.default_rng(seed)
    bounds = [np.sqrt(6 / (dim + hidden))] * 2 + [np.sqrt(6 / (hidden + k))] * 2
    theta = np.concatenate([rng.uniform(-b, b, int(np.prod(s))) for b, s in zip(bounds, shapes(dim, hidden, k))]).astype(np.float32)
    return Network(theta, np.zeros_like(theta), np.zeros_like(theta))


def forward(x: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = parts
    inner = np.maximum(x @ w1 + b1, 0)
    return inner, softmax(inner @ w2 + b2)


def loss_of(x: np.ndarray, y: np.ndarray, parts: list[np.ndarray], block: int = 2048) -> float:
    """Summed loss, a block of rows at a time: a whole task's hidden layer would not stay near the processor."""
    total = 0.0
    for begin in range(0, len(y), block):
        rows = slice(begin, begin + block)
        p = forward(x[rows], parts)[1]
        total -= np.log(np.maximum(p[np.arange(len(p)), y[rows]], 1e-30)).sum(dtype=float)
    return total


class _Gradient:
    """Loss and gradient of a batch, written into arrays that all batches share. The biases are the last row of their weights."""

    def __init__(self, theta: np.ndarray, dim: int, hidden: int, k: int, batch: int, penalty: float):
        self.out, self.penalty = np.empty_like(theta), penalty
        n = (dim + 1) * hidden
        self.first, self.second = theta[:n].reshape(dim + 1, hidden), theta[n:].reshape(hidden + 1, k)  # views: they follow theta
        self.first_out, self.second_out = self.out[:n].reshape(dim + 1, hidden), self.out[n:].reshape(hidden + 1, k)
        self.x = np.ones((batch, dim + 1), dtype=theta.dtype)
        self.inner, self.back, self.on = (np.empty((batch, hidden), dtype=theta.dtype) for _ in range(3))
        self.at = np.arange(batch)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> float:
        n = len(y)
        own, inner, back, on, w2 = self.x[:n], self.inner[:n], self.back[:n], self.on[:n], self.second[:-1]
        own[:, :-1] = x
        np.matmul(own, self.first, out=inner)
        np.copyto(on, inner > 0)
        inner *= on
        p = softmax(inner @ w2 + self.second[-1])
        at = self.at[:n]
        loss = -np.log(np.maximum(p[at, y], 1e-30)).sum()
        p[at, y] -= 1
        np.matmul(p, w2.T, out=back)
        back *= on
        np.matmul(own.T, back, out=self.first_out)
        np.matmul(inner.T, p, out=self.second_out[:-1])
        np.sum(p, axis=0, out=self.second_out[-1])
        self.first_out[:-1] += self.penalty * self.first[:-1]
        self.second_out[:-1] += self.penalty * w2
        self.out /= n
        return float(loss)


def local_epoch(x: np.ndarray, y: np.ndarray, net: Network, dim: int, hidden: int, k: int, rng, batch: int, rate: float, penalty: float):
    """(theta, moments, steps, summed loss) after one epoch over these rows."""
    theta, first, second, steps, total = net.theta.copy(), net.first.copy(), net.second.copy(), net.steps, 0.0
    gradient, g2 = _Gradient(theta, dim, hidden, k, min(batch, len(y)), penalty), np.empty_like(theta)
    g = gradient.out
    order = rng.permutation(len(y))
    for begin in range(0, len(y), batch):
        rows = order[begin:begin + batch]
        total += gradient(x[rows], y[rows])
        steps += 1
        np.multiply(g, g, out=g2)
        first *= _BETA1
        second *= _BETA2
        g *= 1 - _BETA1
        g2 *= 1 - _BETA2
        first += g
        second += g2
        np.sqrt(second, out=g2)
        g2 += _EPS
        np.divide(first, g2, out=g2)
        g2 *= float(rate * np.sqrt(1 - _BETA2 ** steps) / (1 - _BETA1 ** steps))
        theta -= g2
    return theta, first, second, steps, total


def fit(packed: Packed, models: Sequence[Model], k: int, seed: int = 42, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH,
        rate: float = RATE, penalty: float = PENALTY, patience: int = PATIENCE, tol: float = TOL) -> tuple[dict[Model, list[np.ndarray]], dict[Model, list]]:
    """Parameters per model, and per model the (training loss, held-out loss) of every epoch. Rows set aside are only checked;
    without any, all epochs are run."""
    dim = packed.dim
    nets = {m: start(dim, hidden, k, seed) for m in models}
    curves: dict[Model, list] = {m: [] for m in models}
    active = [m for m in models if packed.class_counts(m, k).sum()]
    spark = packed.blocks.context

    def whole_of(part) -> Block | None:
        blocks = list(part)
        if not blocks:
            return None
        x, y, fold, away = (np.concatenate([getattr(b, c) for b in blocks]) for c in ("x", "y", "fold", "aside"))
        return Block(x.astype(np.float32), y, fold, away)

    def scanned(whole: Block, m: Model, net: Network, epoch: int, index: int) -> tuple:
        """(rows, parameters and moments, their loss, loss and number of the rows set aside, steps) after an epoch; the last only checks."""
        seen = whole.seen_by(m)
        check, rows = seen & whole.aside, seen & ~whole.aside
        held = loss_of(whole.x[check], whole.y[check], unflatten(net.theta, dim, hidden, k))
        n, parts = int(rows.sum()), (np.zeros(1), np.zeros(1), np.zeros(1), 0, 0.0)
        if epoch < epochs and n:
            parts = local_epoch(whole.x[rows], whole.y[rows], net, dim, hidden, k, np.random.default_rng([seed, epoch, index]), batch, rate, penalty)
        return n, parts[:3], parts[4], held, int(check.sum()), parts[3]

    def settled(net: Network, curve: list, epoch: int, params: tuple, n: int, loss: float, held: float, checked: int, steps: int) -> bool:
        """Take over the epoch's parameters; whether the model goes on."""
        if epoch:  # the scan has checked what the last epoch made
            held_loss = held / checked if checked else None
            curve[-1] = (curve[-1][0], held_loss)
            if held_loss is None or held_loss < net.best_loss:
                net.best = net.theta
            net.waited = 0 if held_loss is None or held_loss < net.best_loss - tol else net.waited + 1
            net.best_loss = min(net.best_loss, np.inf if held_loss is None else held_loss)
            if net.waited >= patience or epoch == epochs:
                return False
        curve.append((loss / n, None))
        (net.theta, net.first, net.second), net.steps = params, steps
        return True

    def apart(epoch: int) -> int:
        """An epoch by all tasks, which agree at its end."""
        sent = spark.broadcast({m: nets[m] for m in active})

        def run(index: int, part):
            if (whole := whole_of(part)) is None:
                return
            for m, net in sent.value.items():
                n, params, *rest, steps = scanned(whole, m, net, epoch, index)
                # A task's share of the averages. Steps: those of the task that takes most count for all.
                yield m, (*(n * p.astype(float) for p in params), n, *rest, steps)

        def add(a: tuple, b: tuple) -> tuple:
            return (*(p + q for p, q in zip(a[:-1], b[:-1])), max(a[-1], b[-1]))

        found = dict(packed.blocks.mapPartitionsWithIndex(run).reduceByKey(add).collect())  # one per model
        sent.destroy()
        for m in list(active):
            *sums, n, loss, held, checked, steps = found[m]
            if not settled(nets[m], curves[m], epoch, tuple((p / n).astype(np.float32) for p in sums), n, loss, held, checked, steps):
                active.remove(m)
        return epoch + 1

    def alone(epoch: int, n_epochs: int) -> float:
        """Several epochs by the only task; its seconds. Their number is fixed before it begins, so a lost task gives the same again."""
        sent = spark.broadcast({m: (nets[m], curves[m]) for m in active})

        def run(index: int, part):
            began = time.monotonic()
            if (whole := whole_of(part)) is None:
                return
            for m, (net, curve) in sent.value.items():
                net, curve = replace(net), list(curve)  # a broadcast value may serve another attempt
                for e in range(epoch, min(epoch + n_epochs, epochs + 1)):
                    n, params, *rest = scanned(whole, m, net, e, index)
                    if not (goes_on := settled(net, curve, e, params, n, *rest)):
                        break
                yield m, vars(net), curve, goes_on, time.monotonic() - began

        found, seconds = packed.blocks.mapPartitionsWithIndex(run).collect(), 0.0  # one per model
        sent.destroy()
        for m, fields, curve, goes_on, seconds in found:
            nets[m], curves[m] = Network(**fields), curve
            if not goes_on:
                active.remove(m)
        return seconds

    epoch, n_epochs, one = 0, 1, packed.blocks.getNumPartitions() == 1
    while active:
        if one:
            seconds = alone(epoch, n_epochs)
            epoch, n_epochs = epoch + n_epochs, max(1, min(4 * n_epochs, int(SLICE_SECONDS * n_epochs / max(seconds, 1e-3))))
        else:
            epoch = apart(epoch)
    return {m: unflatten(nets[m].theta if nets[m].best is None else nets[m].best, dim, hidden, k) for m in models}, curves


def probabilities(x: np.ndarray, model: list[np.ndarray], _=None) -> np.ndarray:
    p = forward(x.astype(np.float32), model)[1].astype(float)
    return p / p.sum(axis=1, keepdims=True)
