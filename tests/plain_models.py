"""Plain NumPy classifiers that the tests compare the library's models with: exact trees, one model at a time."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

STEPS, RATE = 1000, 0.05
MIN_LEAF, MIN_GAIN, SAME = 2, 1e-10, 1e-10

# The tuning grids.
LOGISTIC_GRID = (0.001, 0.01, 0.1, 0.5, 1.0, 5.0, 10.0, 50.0)
FOREST_GRID = ((50, 3), (100, 4), (100, 5), (200, 4))
BOOSTING_GRID = ((50, 0.1), (100, 0.1), (100, 0.05), (50, 0.2))
DEFAULTS = {"LogisticRegression": 1.0, "RandomForest": (100, 4), "GradientBoostedTrees": (100, 0.1)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x > 30, 1 - 1e-15, np.where(x < -30, 1e-15, 1 / (1 + np.exp(-np.clip(x, -30, 30)))))


def log_odds(p: float) -> float:
    return float(np.log(p / (1 - p))) if 0 < p < 1 else 0.0


@dataclass
class Constant:
    """The dummies: one probability for all."""

    p: float
    base: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)

    def importances(self, n: int) -> np.ndarray:
        return np.zeros(n)


def majority(y: np.ndarray) -> Constant:
    return Constant(0.0 if (y == 0).sum() >= (y == 1).sum() else 1.0)


def prevalence(y: np.ndarray) -> Constant:
    return Constant(float(y.mean()) if len(y) else 0.0)


@dataclass
class Logistic:
    """Full-batch gradient descent of weighted log loss with an L2 penalty of 1 / (C n) on all but the bias."""

    weights: np.ndarray
    bias: float
    base: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, positive: float, c: float = 1.0) -> Logistic:
        w, total, lam = np.where(y == 1, positive, 1.0), None, 1 / (c * max(len(y), 1))
        total = max(w.sum(), 1e-300)
        beta, bias = np.zeros(x.shape[1]), 0.0
        for _ in range(STEPS):
            e = w * (sigmoid(x @ beta + bias) - y)
            beta, bias = beta - RATE * (x.T @ e / total + lam * beta), bias - RATE * e.sum() / total
        out = cls(beta, bias, 0.0)
        out.base = log_odds(float(out.predict(x).mean())) if len(x) else 0.0
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights + self.bias)

    def importances(self, n: int) -> np.ndarray:
        a = np.abs(self.weights)
        return a / a.sum() if a.sum() > 0 else a


@dataclass
class SingleFeature:
    """A logistic model of one column; 0.5 where the column is absent."""

    column: int | None
    inner: Logistic | None
    base: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, positive: float, column: int | None) -> SingleFeature:
        return cls(column, None if column is None else Logistic.fit(x[:, [column]], y, positive, 1.0))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.inner is None else self.inner.predict(x[:, [self.column]])

    def importances(self, n: int) -> np.ndarray:
        out = np.zeros(n)
        if self.column is not None:
            out[self.column] = 1.0
        return out


@dataclass
class Tree:
    """Nodes in arrays; node 0 is the root, leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    n_pos: list[int] = field(default_factory=list)

    def _add(self, value: float, n: int, n_pos: int) -> int:
        for column, x in zip((self.feature, self.threshold, self.left, self.right, self.value, self.n, self.n_pos), (-1, 0.0, -1, -1, value, n, n_pos), strict=True):
            column.append(x)
        return len(self.feature) - 1

    def paths(self, x: np.ndarray):
        """Yields (node, rows that pass it), parents first."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            yield node, rows
            if self.feature[node] >= 0:
                low = x[rows, self.feature[node]] <= self.threshold[node]
                todo += [(self.right[node], rows[~low]), (self.left[node], rows[low])]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for node, rows in self.paths(x):
            if self.feature[node] < 0:
                out[rows] = self.value[node]
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Along each row's path, how far the child's value is from the mean of both children by count."""
        out = np.zeros(x.shape)
        for node, rows in self.paths(x):
            f = self.feature[node]
            if f >= 0:
                a, b = self.left[node], self.right[node]
                mean = (self.n[a] * self.value[a] + self.n[b] * self.value[b]) / (self.n[a] + self.n[b])
                out[rows, f] += np.where(x[rows, f] <= self.threshold[node], self.value[a], self.value[b]) - mean
        return out

    def importances(self, n: int) -> np.ndarray:
        """Shares of the gain in Gini impurity by counts."""
        gini = lambda pos, all_: 2 * (pos / all_) * (1 - pos / all_) if all_ else 0.0
        out = np.zeros(n)
        for k, f in enumerate(self.feature):
            if f >= 0:
                a, b = self.left[k], self.right[k]
                out[f] += self.n[k] * gini(self.n_pos[k], self.n[k]) - self.n[a] * gini(self.n_pos[a], self.n[a]) - self.n[b] * gini(self.n_pos[k] - self.n_pos[a], self.n[b])
        return out / out.sum() if out.sum() > 0 else out


def _cuts(column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of a column, the places where a cut may lie, and the thresholds there."""
    order = np.argsort(column, kind="stable")
    v = column[order]
    at = np.flatnonzero(np.abs(np.diff(v)) >= SAME)
    return order, at, (v[at] + v[at + 1]) / 2


def _grow(x: np.ndarray, features: np.ndarray, depth: int, node_of, gains_of) -> Tree:
    """Grows depth first: node_of(rows) gives (value, n, n_pos), gains_of(rows, order, at) a gain for each cut."""
    tree, todo = Tree(), [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, level, parent, is_left = todo.pop()
        node = tree._add(*node_of(rows))
        if parent >= 0:
            (tree.left if is_left else tree.right)[parent] = node
        if level >= depth or len(rows) <= 2 * MIN_LEAF:
            continue
        best = (MIN_GAIN, -1, 0.0)
        for f in features:
            order, at, thresholds = _cuts(x[rows, f])
            if len(at):
                gain = gains_of(rows, order, at)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float(thresholds[k]))
        if best[1] < 0:
            continue
        low = x[rows, best[1]] <= best[2]
        if low.all() or not low.any():
            continue
        tree.feature[node], tree.threshold[node] = best[1], best[2]
        todo += [(rows[~low], level + 1, node, False), (rows[low], level + 1, node, True)]
    return tree


def classification_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, features: np.ndarray) -> Tree:
    """Weighted Gini; a side's weight, not its count, has to reach MIN_LEAF."""

    def node(rows: np.ndarray) -> tuple[float, int, int]:
        total = w[rows].sum()
        return (float((w[rows] * y[rows]).sum() / total) if total > 0 else 0.5), len(rows), int(y[rows].sum())

    def gains(rows: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
        ww = w[rows][order]
        wl, pl = np.cumsum(ww)[at], np.cumsum(ww * y[rows][order])[at]
        total, pos = ww.sum(), (ww * y[rows][order]).sum()
        gini = lambda p, t: 2 * (p / t) * (1 - p / t)
        wr = total - wl
        with np.errstate(all="ignore"):
            g = gini(pos, total) - wl / total * gini(pl, wl) - wr / total * gini(pos - pl, wr)
        return np.where((wl >= MIN_LEAF) & (wr >= MIN_LEAF), g, -np.inf)

    return _grow(x, features, depth, node, gains)


def regression_tree(x: np.ndarray, r: np.ndarray, depth: int, features: np.ndarray) -> Tree:
    """Variance reduction; leaves hold the mean residual."""

    def node(rows: np.ndarray) -> tuple[float, int, int]:
        return float(r[rows].mean()), len(rows), 0

    def gains(rows: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
        v, n = r[rows][order], len(rows)
        nl = at + 1
        nr = n - nl
        sl, ql = np.cumsum(v)[at], np.cumsum(v * v)[at]
        sr, qr = v.sum() - sl, (v * v).sum() - ql
        left = np.maximum(ql / nl - (sl / nl) ** 2, 0)
        right = np.maximum(qr / nr - (sr / nr) ** 2, 0)
        return np.where((nl >= MIN_LEAF) & (nr >= MIN_LEAF), v.var() - (nl * left + nr * right) / n, -np.inf)

    return _grow(x, features, depth, node, gains)


def _some(rng: np.random.Generator, n: int) -> np.ndarray:
    return rng.permutation(n)[: max(1, int(np.sqrt(n)))]


@dataclass
class Forest:
    """Bootstrap trees, each on one random subset of the square root of the features."""

    trees: list[Tree]
    base: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, positive: float, size: int, depth: int, seed: int) -> Forest:
        w, trees = np.where(y == 1, positive, 1.0), []
        for t in range(size):
            rng = np.random.default_rng([seed & 0xFFFFFFFFFFFFFFFF, t])
            rows = rng.integers(0, len(x), len(x))
            trees.append(classification_tree(x[rows], y[rows], w[rows], depth, _some(rng, x.shape[1])))
        return cls(trees, log_odds(float(y.mean())))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.mean([t.predict(x) for t in self.trees], axis=0), 1e-10, 1 - 1e-10)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.contributions(x) for t in self.trees], axis=0)

    def importances(self, n: int) -> np.ndarray:
        return np.mean([t.importances(n) for t in self.trees], axis=0)


@dataclass
class Boosting:
    """Trees on weighted residuals, added at a learning rate to the log odds of the mean."""

    trees: list[Tree]
    base: float
    rate: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, positive: float, size: int, rate: float, seed: int, depth: int = 3) -> Boosting:
        rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
        w, base = np.where(y == 1, positive, 1.0), log_odds(float(np.clip(y.mean(), 1e-6, 1 - 1e-6)))
        f, trees = np.full(len(y), base), []
        for _ in range(size):
            tree = regression_tree(x, w * (y - sigmoid(f)), depth, _some(rng, x.shape[1]))
            f = f + rate * tree.predict(x)
            trees.append(tree)
        return cls(trees, base, rate)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.clip(sigmoid(self.base + self.rate * np.sum([t.predict(x) for t in self.trees], axis=0)), 1e-10, 1 - 1e-10)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        return self.rate * np.sum([t.contributions(x) for t in self.trees], axis=0)

    def importances(self, n: int) -> np.ndarray:
        return np.mean([t.importances(n) for t in self.trees], axis=0)


def attributions(model, x: np.ndarray) -> np.ndarray:
    """Path contributions of tree ensembles; else importance times distance from the rows' mean."""
    if hasattr(model, "contributions"):
        return model.contributions(x)
    return model.importances(x.shape[1]) * (x - x.mean(0))


def average_area(y: np.ndarray, p: np.ndarray) -> float:
    """Area under the precision-recall curve, trapezoids from (0, 1); of equal probabilities negatives come first."""
    if not (y == 1).any():
        return 0.0
    order = np.lexsort((y, -p))
    tp = np.cumsum(y[order] == 1)
    recall, precision = tp / tp[-1], tp / np.arange(1, len(y) + 1)
    r0, p0 = np.append(0.0, recall[:-1]), np.append(1.0, precision[:-1])
    return float(((recall - r0) * (precision + p0) / 2).sum())


def inner_folds(y: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A test fold for each row: classes shuffled and dealt round robin."""
    if len(y) < 2 * k:
        raise ValueError(f"{len(y)} rows are too few for {k} inner folds")
    out, rng = np.zeros(len(y), int), np.random.default_rng([seed & 0xFFFFFFFFFFFFFFFF, 77])
    for c in (0, 1):
        rows = rng.permutation(np.flatnonzero(y == c))
        out[rows] = np.arange(len(rows)) % k
    return out


def fit(algorithm: str, x: np.ndarray, y: np.ndarray, positive: float, seed: int, setting=None, ec: int | None = None):
    """A fitted model of an algorithm by name."""
    setting = DEFAULTS.get(algorithm) if setting is None else setting
    if algorithm == "DummyMajority":
        return majority(y)
    if algorithm == "DummyStratified":
        return prevalence(y)
    if algorithm == "EcOnlyLogistic":
        return SingleFeature.fit(x, y, positive, ec)
    if algorithm == "LogisticRegression":
        return Logistic.fit(x, y, positive, setting)
    if algorithm == "RandomForest":
        return Forest.fit(x, y, positive, *setting, seed)
    if algorithm == "GradientBoostedTrees":
        return Boosting.fit(x, y, positive, *setting, seed)
    raise ValueError(f"no algorithm {algorithm!r}")


def tunable(algorithm: str, n: int, k: int) -> bool:
    """Whether n rows are enough to tune an algorithm that has settings; else it gets its default."""
    return algorithm not in DEFAULTS or n >= 2 * k


def tune(algorithm: str, x: np.ndarray, y: np.ndarray, positive: float, seed: int, k: int = 3):
    """The setting of the best mean inner area, the first of equally good ones; scaling and weight are the outer fold's."""
    grid = {"LogisticRegression": LOGISTIC_GRID, "RandomForest": FOREST_GRID, "GradientBoostedTrees": BOOSTING_GRID}.get(algorithm)
    if not grid:
        return None
    if not tunable(algorithm, len(y), k):
        return DEFAULTS[algorithm]
    fold = inner_folds(y, k, seed)
    best = (-1.0, DEFAULTS[algorithm])
    for setting in grid:
        score = np.mean([average_area(y[fold == i], fit(algorithm, x[fold != i], y[fold != i], positive, seed, setting).predict(x[fold == i])) for i in range(k)])
        if score > best[0]:
            best = (float(score), setting)
    return best[1]
