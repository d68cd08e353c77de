"""Learners as sums over blocks of rows: batched gradient descent, forests and boosting by histograms.

A step of each learner is a sum over its training rows and a change made by that sum alone: gradients of all its models, or counts of
(tree, node, feature, bin).  ``sums(block)`` gives a block's part as keys and two numbers each, ``advance(keys, numbers)`` takes the total.  A task
whose rows fit in one block runs its steps where the block is; the others run them together, one Spark aggregate a step (``models``).  Both give the same model.

A forest grows all its trees a level at a time; its bootstrap counts are Poisson numbers that a row's hash and the tree's seed fix, so no row has to know of the others.
Values are binned at the distinct values of a feature, or at ``BINS`` quantiles if it has more; with single values in bins, thresholds are the midpoints that exact trees have.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

# Steps, rates, least leaf and gain, the tuning grids and their defaults.
STEPS, RATE = 1000, 0.05
MIN_LEAF, MIN_GAIN, BOOSTING_DEPTH = 2, 1e-10, 3
LOGISTIC_GRID = (0.001, 0.01, 0.1, 0.5, 1.0, 5.0, 10.0, 50.0)
FOREST_GRID = ((50, 3), (100, 4), (100, 5), (200, 4))
BOOSTING_GRID = ((50, 0.1), (100, 0.1), (100, 0.05), (50, 0.2))
GRIDS = {"LogisticRegression": LOGISTIC_GRID, "RandomForest": FOREST_GRID, "GradientBoostedTrees": BOOSTING_GRID}
TREES = ("RandomForest", "GradientBoostedTrees")
DEFAULTS = {"LogisticRegression": 1.0, "RandomForest": (100, 4), "GradientBoostedTrees": (100, 0.1), "EcOnlyLogistic": 1.0}
#: Most bins of a feature.
BINS = 128


def sigmoid(x: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    if np.size(x) and np.max(np.abs(x)) > 30:
        p = np.where(x > 30, 1 - 1e-15, np.where(x < -30, 1e-15, p))
    return p


def log_odds(p: float) -> float:
    return float(np.log(p / (1 - p))) if 0 < p < 1 else 0.0


def sum_parts(values: np.ndarray) -> list[float]:
    """Three numbers that make up the sum of the values, so that ``math.fsum`` of all blocks' parts is the same however rows are dealt."""
    rest, out = values.tolist(), []
    try:
        for _ in range(3):
            out.append(math.fsum(rest))
            rest.append(-out[-1])
    except (OverflowError, ValueError):  # beyond the range of doubles
        out = [float(np.sum(values)), 0.0, 0.0]
    return out


def uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) of rows' hashes, independent for each seed."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) ^ (np.uint64(seed & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


#: Shares of the Poisson distribution of mean 1, summed up.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 20)]))


def feature_subset(seed: int, tree: int, d: int) -> np.ndarray:
    """A tree's features: as many as the root of all, in a random order."""
    return np.random.default_rng([seed & 0xFFFFFFFFFFFFFFFF, tree]).permutation(d)[: max(1, int(np.sqrt(d)))]


@dataclass
class Cuts:
    """A feature's bins: value k lies in bin ``searchsorted(edges, k)``; single are the values of bins that hold one each, else empty."""

    edges: np.ndarray
    single: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Cuts:
        """From distinct values or quantiles in order; with at most BINS they count as all there are."""
        values = np.unique(values)
        if len(values) <= BINS:
            return cls((values[:-1] + values[1:]) / 2, values)
        at = np.unique(np.quantile(values, np.arange(1, BINS) / BINS, method="lower"))
        return cls(at, values[:0])

    def threshold(self, left: int, right: int) -> float:
        """Between two bins that hold rows, with none in between."""
        return float((self.single[left] + self.single[right]) / 2) if len(self.single) else float(self.edges[left])


@dataclass
class Block:
    """Training rows of one task: scaled features, labels, inner folds (-1 without) and hashes; what is derived from them is kept."""

    x: np.ndarray
    y: np.ndarray
    inner: np.ndarray
    h: np.ndarray
    kept: dict = field(default_factory=dict)

    def bins(self, cuts: list[Cuts]) -> np.ndarray:
        if "bins" not in self.kept:
            self.kept["bins"] = np.column_stack([np.searchsorted(c.edges, self.x[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8) if len(cuts) else np.zeros((len(self.y), 0), np.uint8)
        return self.kept["bins"]


class Descent:
    """Full-batch gradient descent of weighted log loss for many models of one task at once, penalty 1 / (C n) on all but the bias.

    Model k leaves out the rows of inner fold held[k]; only the given columns take part (all if None).
    """

    def __init__(self, d: int, positive: float, c: list[float], held: list[int], column: int | None = None, steps: int = STEPS) -> None:
        self.c, self.held, self.positive, self.steps, self.step = np.array(c), np.array(held), positive, steps, 0
        self.column, self.beta, self.bias, self.base = column, np.zeros((d, len(c))), np.zeros(len(c)), np.zeros(len(c))

    @property
    def done(self) -> bool:
        return self.step > self.steps

    def sums(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Gradients, then weights and rows; after the last step, probabilities and rows."""
        if (id(self), "on") not in b.kept:  # the same in all steps
            on = (b.inner[:, None] != self.held) | (self.held < 0)
            w = on * np.where(b.y == 1, self.positive, 1.0)[:, None]
            b.kept[id(self), "on"] = on, w, w.sum(0), on.sum(0)
        on, w, weight, n = b.kept[id(self), "on"]
        p = sigmoid(b.x @ self.beta + self.bias)
        if self.step == self.steps:
            out = np.stack([(on * p).sum(0), n])
        else:
            e = w * (p - b.y[:, None])
            out = np.concatenate([b.x.T @ e, [e.sum(0), weight, n]])
        return np.arange(out.size), np.column_stack([out.ravel(), np.zeros(out.size)])

    def advance(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        total = np.zeros((2 if self.step == self.steps else len(self.beta) + 3, len(self.c)))
        total.ravel()[keys] = numbers[:, 0]
        if self.step == self.steps:
            self.base = np.array([log_odds(p / n) if n else 0.0 for p, n in total.T])
        else:
            weight, lam = np.maximum(total[-2], 1e-300), 1 / (self.c * np.maximum(total[-1], 1))
            change = RATE * (total[:-3] / weight + lam * self.beta)
            if self.column is not None:
                change[np.arange(len(change)) != self.column] = 0
            self.beta, self.bias = self.beta - change, self.bias - RATE * total[-3] / weight
        self.step += 1


class Trees:
    """Trees that grow together, a level a step, over the rows that inner fold ``held`` leaves; nodes are numbered as in a heap, from 1."""

    def __init__(self, cuts: list[Cuts], trees: int, depth: int, seed: int, positive: float, held: int) -> None:
        self.cuts, self.depth, self.seed, self.positive, self.held, self.level = cuts, depth, seed, positive, held, 0
        self.grow(trees)

    def grow(self, trees: int) -> None:
        nodes, d = 2 << self.depth, len(self.cuts)
        self.subsets = [feature_subset(self.seed, t, d) for t in self.numbers(trees)]
        self.feature, self.bin = np.full((trees, nodes), -1), np.zeros((trees, nodes), np.int64)
        self.threshold, self.value, self.n, self.n_pos = (np.zeros((trees, nodes)) for _ in range(4))
        self.open = np.zeros((trees, nodes), bool)
        self.open[:, 1] = True

    def numbers(self, trees: int) -> range:
        return range(trees)

    def rows(self, b: Block) -> np.ndarray:
        return (b.inner != self.held) if self.held >= 0 else np.ones(len(b.y), bool)

    def places(self, t: int, bins: np.ndarray) -> np.ndarray:
        """The node that each row has come to in tree t."""
        at = np.ones(len(bins), np.int64)
        for _ in range(self.depth):
            f = self.feature[t, at]
            go = f >= 0
            if not go.any():
                break
            at = np.where(go, 2 * at + (bins[np.arange(len(bins)), np.maximum(f, 0)] > self.bin[t, at]), at)
        return at

    def cells(self, t: int, bins: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of two numbers by (tree, node, feature of the tree's, bin) over rows in open nodes of this level."""
        at = self.places(t, bins)
        own = np.flatnonzero(self.open[t, at] & (at >> self.level == 1) & (first != 0))
        if not len(own):
            return np.zeros(0, np.int64), np.zeros((0, 2))
        subset = self.subsets[t]
        m, width = len(subset), 1 << self.level
        key = (((at[own] - width)[:, None] * m + np.arange(m)) * (BINS + 1) + bins[np.ix_(own, subset)]).ravel()
        size = width * m * (BINS + 1)
        a, b = (np.bincount(key, np.repeat(v[own], m), size) for v in (first, second))
        some = np.flatnonzero(a)
        return t * size + some, np.column_stack([a[some], b[some]])

    def histograms(self, keys: np.ndarray, numbers: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        m, width = len(self.subsets[t]), 1 << self.level
        size = width * m * (BINS + 1)
        low, high = np.searchsorted(keys, (t * size, (t + 1) * size))
        out = np.zeros((2, size))
        out[:, keys[low:high] - t * size] = numbers[low:high].T
        return tuple(out.reshape(2, width, m, BINS + 1))

    def split(self, t: int, a: np.ndarray, b: np.ndarray, gains) -> None:
        """Closes this level's open nodes or splits them where gains(left a, left b, total a, total b) is greatest, the first of equals."""
        width = 1 << self.level
        for k in np.flatnonzero(self.open[t, width : 2 * width]):
            node = width + k
            total_a, total_b = a[k, 0].sum(), b[k, 0].sum()
            if self.level == 0:
                self.settle(t, node, total_a, total_b)
            self.open[t, node] = False
            if total_a <= 2 * MIN_LEAF:
                continue
            left_a, left_b = np.cumsum(a[k], 1)[:, :-1], np.cumsum(b[k], 1)[:, :-1]
            with np.errstate(all="ignore"):
                gain = gains(left_a, left_b, total_a, total_b)
            gain[(a[k][:, :-1] == 0) | (left_a >= total_a)] = -np.inf  # a cut comes after a bin with rows, before others
            best = int(np.argmax(gain))
            f, cut = divmod(best, BINS)
            if not gain.ravel()[best] > MIN_GAIN:
                continue
            right = cut + 1 + int(np.flatnonzero(a[k, f, cut + 1 :])[0])
            j = int(self.subsets[t][f])
            self.feature[t, node], self.bin[t, node], self.threshold[t, node] = j, cut, self.cuts[j].threshold(cut, right)
            for child, x, y in ((2 * node, left_a[f, cut], left_b[f, cut]), (2 * node + 1, total_a - left_a[f, cut], total_b - left_b[f, cut])):
                self.settle(t, child, x, y)
                self.open[t, child] = self.level + 1 < self.depth

    def heap(self, t: int) -> list[dict]:
        """A tree's nodes from 1 on; leaves have feature -1."""
        return [{"feature": int(f), "threshold": float(h), "value": float(v), "n": float(n), "n_pos": float(p)} for f, h, v, n, p in zip(*(x[t, 1:].tolist() for x in (self.feature, self.threshold, self.value, self.n, self.n_pos)), strict=True)]


class Forest(Trees):
    """Bootstrap trees of weighted Gini, each on one random subset of the features; a side's weight, not its count, has to reach MIN_LEAF."""

    rate = 1.0

    def __init__(self, cuts: list[Cuts], setting: tuple[int, int], seed: int, positive: float, held: int) -> None:
        super().__init__(cuts, setting[0], setting[1], seed, positive, held)
        self.base = 0.0

    @property
    def done(self) -> bool:
        return self.level >= self.depth

    def sums(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        bins, on, parts = b.bins(self.cuts), self.rows(b), []
        if self.level == 0:  # of all rows, for the base value
            parts.append((np.array([-1]), np.array([[on.sum(), (on * b.y).sum()]], float)))
        for t in range(len(self.subsets)):
            count = on * np.searchsorted(_POISSON, uniform(b.h, self.seed * 1_000_003 + t), "right")
            parts.append(self.cells(t, bins, count, count * b.y))
        return np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])

    def settle(self, t: int, node: int, n: float, pos: float) -> None:
        weight = n - pos + self.positive * pos
        self.n[t, node], self.n_pos[t, node], self.value[t, node] = n, pos, self.positive * pos / weight if weight > 0 else 0.5

    def advance(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        if len(keys) and keys[0] == -1:
            self.base = log_odds(numbers[0, 1] / numbers[0, 0]) if numbers[0, 0] else 0.0
            keys, numbers = keys[1:], numbers[1:]

        def gains(n: np.ndarray, pos: np.ndarray, all_n: float, all_pos: float) -> np.ndarray:
            weigh = lambda n, pos: n - pos + self.positive * pos
            gini = lambda pos, w: 2 * (self.positive * pos / w) * (1 - self.positive * pos / w)
            left, total = weigh(n, pos), weigh(all_n, all_pos)
            right = weigh(all_n - n, all_pos - pos)
            g = gini(all_pos, total) - left / total * gini(pos, left) - right / total * gini(all_pos - pos, right)
            return np.where((left >= MIN_LEAF) & (right >= MIN_LEAF), g, -np.inf)

        for t in range(len(self.subsets)):
            self.split(t, *self.histograms(keys, numbers, t), gains)
        self.level += 1

    def trees(self) -> list[list[dict]]:
        return [self.heap(t) for t in range(len(self.subsets))]


class Boosting(Trees):
    """Regression trees of weighted residuals, one after the other, added at a learning rate to the log odds of the mean."""

    def __init__(self, cuts: list[Cuts], setting: tuple[int, float], seed: int, positive: float, held: int) -> None:
        self.size, self.rate, self.base, self.grown, self.history = setting[0], setting[1], None, 0, []
        super().__init__(cuts, 1, BOOSTING_DEPTH, seed, positive, held)

    def numbers(self, trees: int) -> range:
        return range(self.grown, self.grown + trees)

    @property
    def done(self) -> bool:
        return self.grown >= self.size

    def sums(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        on = self.rows(b)
        if self.base is None:
            return np.array([-1]), np.array([[on.sum(), (on * b.y).sum()]], float)
        bins = b.bins(self.cuts)
        told, f = b.kept.get((id(self), "f"), (0, np.full(len(b.y), self.base)))
        for tree in self.history[told:]:
            f = f + self.rate * tree.value[0, tree.places(0, bins)]
        b.kept[id(self), "f"] = len(self.history), f
        r = np.where(b.y == 1, self.positive, 1.0) * (b.y - sigmoid(f))
        return self.cells(0, bins, on.astype(float), on * r)

    def settle(self, t: int, node: int, n: float, total: float) -> None:
        self.n[t, node], self.value[t, node] = n, total / n if n else 0.0

    def advance(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        if self.base is None:
            n, pos = numbers[0] if len(numbers) else (0.0, 0.0)
            self.base = log_odds(float(np.clip(pos / n if n else 0.5, 1e-6, 1 - 1e-6)))
            return

        def gains(n: np.ndarray, s: np.ndarray, all_n: float, all_s: float) -> np.ndarray:
            # How much the variance falls: squares cancel but for those of the sums.
            g = (s * s / n + (all_s - s) ** 2 / (all_n - n) - all_s**2 / all_n) / all_n
            return np.where((n >= MIN_LEAF) & (all_n - n >= MIN_LEAF), g, -np.inf)

        self.split(0, *self.histograms(keys, numbers, 0), gains)
        self.level += 1
        if self.level >= self.depth or not self.open.any():
            tree = object.__new__(Trees)
            tree.__dict__ = {k: self.__dict__[k] for k in ("feature", "bin", "threshold", "value", "n", "n_pos", "depth")}
            self.history.append(tree)
            self.grown, self.level = self.grown + 1, 0
            self.grow(1)

    def trees(self) -> list[list[dict]]:
        return [tree.heap(0) for tree in self.history]


@dataclass(frozen=True)
class Wanted:
    """Models to be fitted for a task: an algorithm, its settings, and for each the inner folds that are held out (-1: none)."""

    algorithm: str
    seed: int
    settings: tuple
    held: tuple[int, ...] = (-1,)
    column: int | None = None

    def learners(self, d: int, positive: float, cuts: list[Cuts] | None) -> list[tuple[list[tuple[int, int]], object]]:
        """(setting, held) of each model, and the learner of these models."""
        each = [(s, k) for s in range(len(self.settings)) for k in self.held]
        if self.algorithm in ("LogisticRegression", "EcOnlyLogistic"):
            return [(each, Descent(d, positive, [self.settings[s] for s, _ in each], [k for _, k in each], self.column))]
        kind = Forest if self.algorithm == "RandomForest" else Boosting
        return [([(s, k)], kind(cuts, self.settings[s], self.seed, positive, k)) for s, k in each]


def run(learner, block: Block) -> None:
    """All steps of a learner whose rows are one block."""
    while not learner.done:
        keys, numbers = learner.sums(block)
        order = np.argsort(keys, kind="stable")
        learner.advance(keys[order], numbers[order])


def model_rows(names: list[tuple[int, int]], learner) -> list[dict]:
    """A learner's models as rows of the model relation (without task and scaling)."""
    if isinstance(learner, Descent):
        return [{"setting": s, "held": k, "weights": learner.beta[:, i].tolist(), "bias": float(learner.bias[i]), "base": 0.0 if learner.column is not None else float(learner.base[i]), "rate": None, "trees": None} for i, (s, k) in enumerate(names)]
    ((s, k),) = names
    return [{"setting": s, "held": k, "weights": None, "bias": None, "base": float(learner.base or 0.0), "rate": None if isinstance(learner, Forest) else float(learner.rate), "trees": learner.trees()}]
