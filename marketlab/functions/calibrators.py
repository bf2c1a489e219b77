"""Probability calibrators and boosted trees in NumPy, for grouped kernels."""

from __future__ import annotations

import numpy as np

from marketlab.functions.trees import Forest, Tree, sequential_draw, sorted_rows, uniform_draw

EPSILON = 1e-6


def isotonic(p: np.ndarray, y: np.ndarray):
    """The non-decreasing fit of y by p (pool adjacent violators), linear between the ends of its blocks and constant beyond them."""
    x, at = np.unique(p, return_inverse=True)
    n = np.bincount(at).astype(float)
    level = np.bincount(at, weights=y) / n
    blocks: list[list[float]] = []  # mean, weight, first, last
    for k in range(len(x)):
        blocks.append([level[k], n[k], k, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * w) / (b[1] + w), b[1] + w, last
    knots = np.array([x[int(k)] for b in blocks for k in (b[2], b[3])])
    values = np.array([b[0] for b in blocks for _ in range(2)])
    return lambda q: np.interp(q, knots, values)


def platt(p: np.ndarray, y: np.ndarray, steps: int = 100):
    """A logistic of the raw probability, by Newton's method with a vanishing penalty."""
    ab, x = np.zeros(2), np.stack([p, np.ones(len(p))], axis=1)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ ab, -35, 35)))
        grad = x.T @ (q - y) + 1e-10 * ab
        step = np.linalg.solve((x * np.maximum(q * (1 - q), 1e-10)[:, None]).T @ x + 1e-10 * np.eye(2), grad)
        ab = ab - step
        if np.abs(step).max() < 1e-10:
            break
    return lambda q: 1 / (1 + np.exp(-np.clip(ab[0] * q + ab[1], -35, 35)))


def brier(p: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean((np.clip(p, EPSILON, 1 - EPSILON) - y) ** 2))


class Boosted:
    """Gradient boosting on the log loss: each tree fits the residuals of the probability."""

    def __init__(self, n_estimators: int = 100, max_depth: int | None = 3, min_leaf: int = 5, rate: float = 0.1, seed: int = 0):
        self.n, self.depth, self.leaf, self.rate, self.seed = n_estimators, max_depth, min_leaf, rate, seed

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Boosted:
        w = np.ones(len(y)) if w is None else w
        share = np.clip(np.average(y, weights=w), EPSILON, 1 - EPSILON)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        f, orders = np.full(len(y), self.base), sorted_rows(x)
        for t in range(self.n):
            p = 1 / (1 + np.exp(-f))
            # residuals brought to [0, 1], where the tree's impurity is that of their spread
            tree = Tree(self.depth, self.leaf, None, np.random.default_rng([self.seed, t])).fit(x, (y - p + 1) / 2, w, orders)
            self.trees.append(tree)
            f = f + self._step(tree, x)
        return self

    def _step(self, tree: Tree, x: np.ndarray) -> np.ndarray:
        # 4: the curvature of the log loss is at most a quarter
        return 4 * self.rate * (2 * tree.predict(x) - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum(self._step(t, x) for t in self.trees))))


def fitted(kind: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, horizons: tuple[np.ndarray, np.ndarray], options: dict, seed: int):
    """A model of a kind: "sequential" (bootstrap by uniqueness of horizons), "forest" (weighted rows) or "boosted"."""
    if kind == "boosted":
        return Boosted(options.get("n_estimators", 100), options.get("max_depth", 3) or 6, options.get("min_leaf", 5), seed=seed).fit(x, y, w)
    forest = Forest(options.get("n_estimators", 100), options.get("max_depth", 5), options.get("min_leaf", 5), seed=seed)
    if kind == "forest":
        return forest.fit(x, y, uniform_draw(w))
    if kind == "sequential":
        return forest.fit(x, y, sequential_draw(*horizons, w, options.get("bootstrap_fraction", 1.0)))
    raise ValueError(f"unknown model kind {kind}")


def purged_folds(t0: np.ndarray, t1: np.ndarray, n_splits: int, embargo: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(train, test) rows of contiguous folds by t0, without train rows that meet a test fold's span or follow it by up to embargo rows."""
    order = np.argsort(t0, kind="stable")
    n, out = len(t0), []
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    edges = [i * n // n_splits for i in range(n_splits + 1)]
    for a, b in zip(edges, edges[1:]):
        test = order[a:b]
        if not len(test):
            continue
        lo, hi = t0[test].min(), t1[test].max()
        keep = ((place < a) | (place >= b + embargo)) & ((t1 < lo) | (t0 > hi))
        out.append((np.flatnonzero(keep), test))
    return out


def normalized(w: np.ndarray) -> np.ndarray:
    return w * len(w) / w.sum() if w.sum() > 0 else np.ones(len(w))


def inner_fold(kind: str, train: tuple, options: dict, inner_splits: int, embargo: int, seed: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of train (x, y, w, t0, t1) that its kth purged fold tests, and their probabilities; none if the fold leaves too little to fit on."""
    x, y, w, t0, t1 = train
    folds = purged_folds(t0, t1, inner_splits, embargo)
    rows, test = folds[k] if k < len(folds) else (np.zeros(0, np.int64),) * 2
    if len(rows) < 2 or min(np.bincount(y[rows].astype(int), minlength=2)) < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    return test, fitted(kind, x[rows], y[rows], normalized(w)[rows], (t0[rows], t1[rows]), options, seed + 1 + k).predict(x[test])


def chosen(oof: np.ndarray, y: np.ndarray, raw: np.ndarray, hold: np.ndarray) -> dict:
    """raw, probabilities of rows of labels hold, with the calibrator of lower Brier score on them, fitted on out-of-fold probabilities oof of labels y."""
    if len(y) < 2 or len(np.unique(y)) < 2:
        raise ValueError("too few out-of-fold probabilities, or of one class only")
    both = {name: np.clip(make(oof, y)(raw), EPSILON, 1 - EPSILON) for name, make in (("isotonic", isotonic), ("sigmoid", platt))}
    scores = {name: brier(p, hold) for name, p in both.items()}
    method = "isotonic" if scores["isotonic"] <= scores["sigmoid"] else "sigmoid"
    return {"raw": raw, "p": both[method], "method": method, "brier": scores[method], "brier_raw": brier(raw, hold), **{f"brier_{k}": v for k, v in scores.items()}}


def calibrated(kind: str, train: tuple, hold: tuple, options: dict, inner_splits: int, embargo: int, seed: int) -> dict:
    """A model of train (x, y, w, t0, t1) with the calibrator of lower Brier score on hold (x, y), fitted on purged out-of-fold probabilities.

    Gives raw and p, probabilities of hold, method and the Brier scores. A tie goes to isotonic regression. Raises ValueError where the
    folds leave too little to fit on.
    """
    x, y, w, t0, t1 = train
    oof = np.full(len(y), np.nan)
    for k in range(inner_splits):
        rows, p = inner_fold(kind, train, options, inner_splits, embargo, seed, k)
        oof[rows] = p
    known = ~np.isnan(oof)
    return chosen(oof[known], y[known], fitted(kind, x, y, normalized(w), (t0, t1), options, seed).predict(hold[0]), hold[1])
