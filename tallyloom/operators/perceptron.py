"""Multilayer perceptron trained by data-parallel mini-batch rounds, for several feature sets at once.

A round is one pass over the stored blocks, an epoch.  Every task starts from the shared weights and optimiser state, takes its
mini-batch steps over its own blocks, and returns weights and state; their mean by rows starts the next round.  A
step uses ``batch`` rows over all tasks together.  A round has a task per core and no more, so a larger table brings longer
tasks, not smaller steps that cost more a row.  The epoch with the best average precision on the tuning rows is
kept, and patience ends a fit; one whose loss or weights stop being finite has failed and cannot be chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, functions as F

from ..session import importable
from . import blocks as B


# Layers and training budget.
@dataclass(frozen=True)
class Budget:
    hidden: tuple[int, ...] = (64, 32)
    epochs: int = 30
    patience: int = 5
    reset: float = 1e-4
    rate: float = 3e-4
    decay: float = 1e-4
    dropout: float = 0.1
    batch: int = 4096
    clip: float = 5.0
    seed: int = 7


class Network:
    """Shapes of the layers; the parameters are one flat vector, layer by layer weights then offsets."""

    def __init__(self, inputs: int, hidden: tuple[int, ...]):
        self.sizes = [inputs, *hidden, 1]
        self.cuts = np.cumsum([0, *(n for a, b in zip(self.sizes, self.sizes[1:]) for n in (a * b, b))])

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [flat[a:b] for a, b in zip(self.cuts, self.cuts[1:])]
        return [(w.reshape(a, b), o) for (a, b), w, o in zip(zip(self.sizes, self.sizes[1:]), parts[::2], parts[1::2])]

    def begin(self, offset: float, seed: int) -> np.ndarray:
        """Uniform within one over the root of a layer's inputs; the last offset is the log odds of the training rows."""
        rng = np.random.default_rng(seed)
        flat = np.concatenate([rng.uniform(-1, 1, n) / np.sqrt(a) for a, b in zip(self.sizes, self.sizes[1:]) for n in (a * b, b)])
        flat[-1] = offset
        return flat

    def logits(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        layers = self.layers(flat)
        for w, o in layers[:-1]:
            x = np.maximum(x @ w + o, 0)
        w, o = layers[-1]
        return (x @ w + o)[:, 0]

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, masks: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """Mean log loss and its gradient; ``masks`` scale the hidden units."""
        layers, held = self.layers(flat), [x]
        for (w, o), m in zip(layers[:-1], masks):
            h = held[-1] @ w
            h += o
            np.maximum(h, 0, out=h)
            h *= m
            held.append(h)
        w, o = layers[-1]
        z = (held[-1] @ w + o)[:, 0]
        loss = float(np.mean(np.logaddexp(0, z) - y * z))
        back = ((1 / (1 + np.exp(-z)) - y) / len(y))[:, None]
        out: list[np.ndarray] = []
        for k in range(len(layers) - 1, -1, -1):
            out[:0] = [(held[k].T @ back).ravel(), back.sum(0)]
            if k:
                back = back @ layers[k][0].T
                back *= held[k] > 0
                back *= masks[k - 1]
        return loss, np.concatenate(out)


@dataclass
class State:
    """Weights with the optimiser's two moments and its step count, and what a round saw."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0
    rows: float = 0.0
    loss: float = 0.0
    clipped: int = 0
    updates: int = 0
    norm: float = 0.0


def steps(net: Network, state: State, x: np.ndarray, y: np.ndarray, budget: Budget, batch: int, seed: list[int]) -> None:
    """Mini-batch steps over the rows of a block in a random order: clipped gradient, Adam, decay apart from the gradient."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order], y[order]
    keep = 1 - budget.dropout
    hidden = net.sizes[1:-1]
    w, first, second, room = state.weights, state.first, state.second, np.empty_like(state.weights)
    for at in range(0, len(y), batch):
        rows = min(batch, len(y) - at)
        masks = [(rng.random((rows, n)) < keep) * (1 / keep) for n in hidden]
        loss, g = net.gradient(w, x[at:at + rows], y[at:at + rows], masks)
        norm = float(np.sqrt(g @ g))
        state.norm = max(state.norm, norm)
        if norm > budget.clip:
            g *= budget.clip / norm
            state.clipped += 1
        state.steps += 1
        # in place: first += 0.1 (g - first), second += 0.001 (g g - second)
        np.subtract(g, first, out=room)
        room *= 0.1
        first += room
        g *= g
        g -= second
        g *= 0.001
        second += g
        np.divide(second, 1 - 0.999 ** state.steps, out=room)
        np.sqrt(room, out=room)
        room += 1e-8
        np.divide(first, room, out=room)
        room *= budget.rate / (1 - 0.9 ** state.steps)
        w *= 1 - budget.rate * budget.decay
        w -= room
        state.rows += rows
        state.loss += loss * rows
        state.updates += 1


def _sum(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    out = {}
    for k, x in a.items():
        y = b[k]
        out[k] = State(x.weights + y.weights, x.first + y.first, x.second + y.second, x.steps + y.steps, x.rows + y.rows, x.loss + y.loss,
                       x.clipped + y.clipped, x.updates + y.updates, max(x.norm, y.norm))
    return out


def _by_rows(packed: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(B.opened(packed, 4 * width * rows), np.float32).reshape(width, rows).T.astype(float, order="C")


def _picked(x: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Columns of a row-major block; the first ones without a copy."""
    return x[:, :len(cols)] if np.array_equal(cols, np.arange(len(cols))) else x[:, cols]


def _per_core(rows: RDD) -> RDD:
    """Blocks of several stored partitions to one task, where there are more of them than cores."""
    cores = rows.context.defaultParallelism
    return rows.coalesce(cores) if rows.getNumPartitions() > cores else rows


def _round(rows: RDD, work: dict[int, tuple[Network, State, np.ndarray]], width: int, budget: Budget, batch: int, epoch: int) -> dict[int, State]:
    """One epoch of every fit: the sums of the tasks' states weighted by their rows."""

    def part(found):
        out = {k: State(s.weights.copy(), s.first.copy(), s.second.copy(), s.steps) for k, (_, s, _) in work.items()}
        for block, _, y, packed in found:
            x = _by_rows(packed, width, len(y))
            for k, (net, _, cols) in work.items():
                steps(net, out[k], _picked(x, cols), y, budget, batch, [budget.seed, epoch, block])
        for s in out.values():
            s.weights, s.first, s.second, s.steps = (v * s.rows for v in (s.weights, s.first, s.second, s.steps))
        return out if all(s.rows for s in out.values()) else None

    return B.total(rows, part, _sum)


def _looked(rows: RDD, work: dict[int, tuple[Network, State, np.ndarray]], width: int) -> dict[int, tuple]:
    def part(found):
        out: dict = {}
        for _, _, y, packed in found:
            x = _by_rows(packed, width, len(y))
            for k, (net, s, cols) in work.items():
                out = B.add_counts(out, {k: B.counted(net.logits(s.weights, _picked(x, cols)), y)})
        return out

    return B.total(rows, part, B.add_counts) or {}


class Patience:
    """The best epoch by average precision, then log loss, and whether the fit goes on: gains below ``reset`` use up patience."""

    def __init__(self, limit: int, reset: float):
        self.limit, self.reset, self.best, self.epoch, self.mark, self.waited = limit, reset, (-np.inf, np.inf), 0, -np.inf, 0

    def goes_on(self, epoch: int, precision: float, loss: float) -> bool:
        if precision > self.best[0] or (precision == self.best[0] and loss < self.best[1]):
            self.best, self.epoch = (precision, loss), epoch
        if precision >= self.mark + self.reset:
            self.mark, self.waited = precision, 0
        else:
            self.waited += 1
        return self.waited < self.limit


@dataclass
class Perceptron:
    """A fitted network on raw columns, which hold no missing values."""

    columns: list[str]
    hidden: tuple[int, ...]
    weights: np.ndarray

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        importable(df.sparkSession)
        net, weights, n = Network(len(self.columns), self.hidden), self.weights, len(self.columns)
        source = df.select(*keep, *[F.col(c).cast("double").alias(f"__{k}") for k, c in enumerate(self.columns)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = B.matrix(b, [f"__{k}" for k in range(n)]).astype(np.float32).astype(float)
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(1 / (1 + np.exp(-net.logits(weights, x.T))))], [*keep, "pd"])

        return source.mapInArrow(run, "".join(f"`{c}` {t}, " for c, t in df.select(*keep).dtypes) + "pd double")


@dataclass
class Course:
    """How a fit went: its best epoch, the epochs run, and per epoch loss, average precision, clipped steps and largest gradient."""

    feature_set: str
    best: int = 0
    executed: int = 0
    failed: bool = False
    model: Perceptron | None = None
    history: list[tuple] = field(default_factory=list)


def fit(train: DataFrame, tuning: DataFrame, feature_sets: dict[str, list[str]], budget: Budget = Budget(), key: str = "case_id", label: str = "target") -> list[Course]:
    """One network per feature set; rows may hold no null."""
    columns = list(dict.fromkeys(c for cols in feature_sets.values() for c in cols))
    pack = lambda x: B.pressed(x.astype(np.float32))
    rows, looks = B.store(train, columns, "dense-train", key, label, pack), B.store(tuning, columns, "dense-tuning", key, label, pack)
    n, pos = B.total(rows, lambda found: sum((np.array([len(y), y.sum()]) for _, _, y, _ in found), np.zeros(2)), np.add)
    if not 0 < pos < n:
        raise ValueError("both classes are needed to fit")
    tasks = _per_core(rows)
    batch = max(64, budget.batch // tasks.getNumPartitions())
    courses, work, waits = [], {}, {}
    for k, (name, cols) in enumerate(feature_sets.items()):
        net = Network(len(cols), budget.hidden)
        weights = net.begin(float(np.log(pos / (n - pos))), budget.seed)
        courses.append(Course(name))
        work[k] = (net, State(weights, np.zeros_like(weights), np.zeros_like(weights)), np.array([columns.index(c) for c in cols]))
        waits[k] = Patience(budget.patience, budget.reset)
    for epoch in range(1, budget.epochs + 1):
        sums = _round(tasks, work, len(columns), budget, batch, epoch)
        for k, s in sums.items():
            net, _, cols = work[k]
            mean = State(*(v / s.rows for v in (s.weights, s.first, s.second, s.steps)))
            if not (np.isfinite(s.loss) and np.isfinite(mean.weights).all()):
                courses[k].failed = True
                del work[k]
                continue
            work[k] = (net, mean, cols)
        for k, found in _looked(looks, work, len(columns)).items():
            c, s = courses[k], sums[k]
            precision, loss = B.ranked(found)
            c.executed = epoch
            if not np.isfinite(precision):
                c.failed = True
                del work[k]
                continue
            c.history.append((epoch, s.loss / s.rows, precision, loss, s.clipped, float(s.norm), s.updates))
            on = waits[k].goes_on(epoch, precision, loss)
            if waits[k].epoch == epoch:
                c.best, c.model = epoch, Perceptron(list(feature_sets[c.feature_set]), budget.hidden, work[k][1].weights.copy())
            if not on:
                del work[k]
        if not work:
            break
    rows.unpersist(), looks.unpersist()
    return courses
