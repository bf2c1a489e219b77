"""Classification trees and forests in NumPy, for grouped kernels: no tree library is assumed on executors."""

from __future__ import annotations

import math

import numpy as np


def sorted_rows(x: np.ndarray) -> np.ndarray:
    """(features, rows): the rows in order of each feature."""
    return np.argsort(x.T, axis=1, kind="stable")


class Tree:
    """CART by Gini impurity on weighted rows."""

    def __init__(self, max_depth: int | None = 5, min_leaf: int = 5, max_features: int | None = None, rng: np.random.Generator | None = None):
        self.max_depth, self.min_leaf, self.max_features = max_depth or 64, min_leaf, max_features
        self.rng = rng or np.random.default_rng(0)
        self.feature, self.cut, self.left, self.right, self.value, self.cover = [], [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, orders: np.ndarray | None = None) -> Tree:
        """orders: sorted_rows(x), if several trees share it; the tree is the same."""
        self._grow(x, y, w, np.arange(len(y)), 0, orders)
        self.arrays = [np.array(a) for a in (self.feature, self.cut, self.left, self.right, self.value)]
        self.covers = np.array(self.cover)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray, depth: int, orders: np.ndarray | None) -> int:
        node, total = len(self.feature), float(w[rows].sum())
        p = float((w[rows] * y[rows]).sum()) / total if total > 0 else 0.0
        for a, v in zip((self.feature, self.cut, self.left, self.right, self.value, self.cover), (-1, 0.0, -1, -1, p, total)):
            a.append(v)
        if depth >= self.max_depth or len(rows) < 2 * self.min_leaf or p in (0.0, 1.0):
            return node
        k = x.shape[1]
        tried = np.sort(self.rng.permutation(k)[: self.max_features or k])
        best = (total * p * (1 - p) - 1e-12, -1, 0.0)
        for f in tried:
            order = rows[np.argsort(x[rows, f], kind="stable")] if orders is None else orders[f]
            v, cw, cy = x[order, f], np.cumsum(w[order]), np.cumsum(w[order] * y[order])
            at = np.flatnonzero(v[:-1] < v[1:])
            at = at[(at + 1 >= self.min_leaf) & (len(order) - at - 1 >= self.min_leaf)]
            if not len(at):
                continue
            lw, ly = cw[at], cy[at]
            rw, ry = cw[-1] - lw, cy[-1] - ly
            cost = ly - ly * ly / np.maximum(lw, 1e-300) + ry - ry * ry / np.maximum(rw, 1e-300)
            i = int(cost.argmin())
            if cost[i] < best[0]:
                best = (float(cost[i]), int(f), float((v[at[i]] + v[at[i] + 1]) / 2))
        if best[1] < 0:
            return node
        self.feature[node], self.cut[node] = best[1], best[2]
        low = x[rows, best[1]] <= best[2]
        for side, child in ((low, self.left), (~low, self.right)):
            own = orders
            if orders is not None and depth + 1 < self.max_depth:
                there = np.zeros(len(x), bool)
                there[rows[side]] = True
                own = orders[there[orders]].reshape(k, -1)
            child[node] = self._grow(x, y, w, rows[side], depth + 1, own)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = self.arrays
        at = np.zeros(len(x), np.int64)
        while (live := feature[at] >= 0).any():
            rows = np.flatnonzero(live)
            n = at[rows]
            at[rows] = np.where(x[rows, feature[n]] <= cut[n], left[n], right[n])
        return value[at]


    def shapley(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): each feature's share of the prediction, by the weights of train rows where a feature is not known; exact.

        A leaf of value v whose path asks about d features is a game: a known feature passes the row or not (o), an unknown one lets the share z of
        weight through. A feature's share is v (o - z) times the sum over sets of the other features of the products of their o or z, which
        depends on a set by its size only in the coefficients, so it is a product of d - 1 linear factors.
        """
        feature, cut, left, right, value = self.arrays
        out = np.zeros((len(x), x.shape[1]))
        todo: list[tuple[int, dict]] = [(0, {})]
        while todo:
            node, path = todo.pop()
            f = int(feature[node])
            if f >= 0:
                for child, passes in ((int(left[node]), x[:, f] <= cut[node]), (int(right[node]), x[:, f] > cut[node])):
                    o, z = path.get(f, (np.ones(len(x), bool), 1.0))
                    share = self.covers[child] / self.covers[node] if self.covers[node] > 0 else 0.5
                    todo.append((child, path | {f: (o & passes, z * share)}))
                continue
            d = len(path)
            for f, (o, z) in path.items():
                sums = np.zeros((d, len(x)))
                sums[0] = 1
                for k, (g, (p, q)) in enumerate((g, v) for g, v in path.items() if g != f):
                    sums[1 : k + 2] = sums[1 : k + 2] * q + sums[: k + 1] * p
                    sums[0] *= q
                weight = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
                out[:, f] += value[node] * (o - z) * (weight @ sums)
        return out


class Forest:
    """Trees on bootstrap draws; a draw is given, or made uniformly. Weights are those of the rows drawn."""

    def __init__(self, n_estimators: int = 100, max_depth: int | None = 5, min_leaf: int = 5, max_features: str | int | None = "sqrt", seed: int = 0):
        self.n, self.depth, self.leaf, self.max_features, self.seed = n_estimators, max_depth, min_leaf, max_features, seed
        self.trees: list[Tree] = []

    def fit(self, x: np.ndarray, y: np.ndarray, draw=None, part: range | None = None) -> Forest:
        """part: which of the trees to fit, all by default; a tree is the same in any part."""
        k = max(1, int(x.shape[1] ** 0.5)) if self.max_features == "sqrt" else self.max_features
        rngs = [np.random.default_rng([self.seed, t]) for t in (range(self.n) if part is None else part)]
        draws = draw.many(rngs) if isinstance(draw, SequentialDraw) else (draw(rng) if draw else (rng.integers(0, len(y), len(y)), None) for rng in rngs)
        for rng, (rows, w) in zip(rngs, draws):
            self.trees.append(Tree(self.depth, self.leaf, k, rng).fit(x[rows], y[rows], np.ones(len(rows)) if w is None else w))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)

    def shapley(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.shapley(x) for t in self.trees], axis=0)


def sequential_bootstrap(t0: np.ndarray, t1: np.ndarray, n_samples: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Indices drawn in turn with a chance in proportion to the mean of 1 / (1 + draws that cover a point), and their uniqueness in the draw.

    A horizon is a stretch of the grid of all t0 and t1, so its mean is a difference of prefix sums: a draw costs
    the grid and the events once, not their product.
    """
    grid = np.unique(np.concatenate([t0, t1]))
    a, b = np.searchsorted(grid, t0), np.searchsorted(grid, t1) + 1
    cover, out = np.zeros(len(grid)), np.empty(n_samples, np.int64)
    for k in range(n_samples):
        p = np.concatenate([[0.0], np.cumsum(1 / (1 + cover))])
        chance = np.maximum((p[b] - p[a]) / (b - a), 1e-12)
        out[k] = rng.choice(len(t0), p=chance / chance.sum())
        cover[a[out[k]] : b[out[k]]] += 1
    p = np.concatenate([[0.0], np.cumsum(1 / np.maximum(cover, 1))])
    return out, (p[b[out]] - p[a[out]]) / (b[out] - a[out])


#: Of sequential_bootstraps(): entries under one sum, and (generators, events) held at a time.
FAN, CELLS = 64, 6_000_000


def sequential_bootstraps(t0: np.ndarray, t1: np.ndarray, n_samples: int, rngs: list[np.random.Generator]) -> tuple[np.ndarray, np.ndarray]:
    """The draws of sequential_bootstrap() for each generator, (generators, n_samples), and their uniqueness.

    A draw changes the chances of those events only that its horizon meets, so these are made anew and nothing else. Chances stand
    under sums of FAN entries and of FAN sums; an event is found from the top down. All generators go a step together. Draws
    differ from sequential_bootstrap()'s only where a number falls within rounding of the bound between two events.
    """
    n, lanes = len(t0), len(rngs)
    grid = np.unique(np.concatenate([t0, t1]))
    a, b = np.searchsorted(grid, t0), np.searchsorted(grid, t1) + 1
    length = b - a
    order = np.argsort(a, kind="stable")
    in_order = bool((order == np.arange(n)).all())
    upto = np.maximum.accumulate(b[order])
    # by start, what an event meets lies in [first, last]; their horizons lie in [begin, upto[last])
    first, last = np.searchsorted(upto, a, "right"), np.searchsorted(a[order], b, "left") - 1
    begin = a[order][first]
    met, span, longest = int((last - first).max()) + 1, int((upto[last] - begin).max()), int(length.max())
    if 2 * (met + span) > n:  # few events, or horizons so long that a draw changes most chances
        one = [sequential_bootstrap(t0, t1, n_samples, rng) for rng in rngs]
        return np.stack([rows for rows, _ in one]), np.stack([u for _, u in one])

    tops = -(-n // FAN**2)
    leaves = np.zeros((lanes, tops * FAN * FAN))
    leaves[:, :n] = 1.0
    sums = leaves.reshape(lanes, -1, FAN).sum(2)
    top = sums.reshape(lanes, -1, FAN).sum(2)
    cover = np.ones((lanes, len(grid) + max(span, longest)))  # one more than the draws that cover a point
    flat, flat_sums, flat_top, flat_cover = leaves.ravel(), sums.ravel(), top.ravel(), cover.ravel()
    by_block, by_sum = leaves.reshape(-1, FAN), sums.reshape(-1, FAN)
    lane = np.arange(lanes)
    at_leaf, at_sum, at_top, at_cover = (lane * x.shape[1] for x in (leaves, sums, top, cover))
    c_top, c_fan, prefix = np.zeros((lanes, tops + 1)), np.zeros((lanes, FAN + 1)), np.zeros((lanes, span + 1))
    row_top, row_fan, row_prefix = lane * (tops + 1), lane * (FAN + 1), lane * (span + 1)
    to_met, to_span, to_longest = np.arange(met), np.arange(span), np.arange(longest)
    blocks_met = (met + FAN - 2) // FAN + 1
    to_block, to_sum = np.arange(blocks_met), np.arange((blocks_met + FAN - 2) // FAN + 1)
    out = np.empty((n_samples, lanes), np.int32 if n < 2**31 else np.int64)

    def below(values: np.ndarray, c: np.ndarray, row: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each lane, which of values holds the target, from which what stands before is taken."""
        np.cumsum(values, axis=1, out=c[:, 1:])
        c[:, -1] = np.inf
        k = (c[:, 1:] > target[:, None]).argmax(1)
        target -= c.ravel().take(row + k)
        return k

    for k in range(n_samples):
        if k % 1024 == 0:
            numbers = np.stack([rng.random(min(1024, n_samples - k)) for rng in rngs], axis=1)
        target = numbers[k % 1024] * top.sum(1)
        at = below(top, c_top, row_top, target)
        at = at * FAN + below(by_sum.take(at_top + at, axis=0), c_fan, row_fan, target)
        at = at * FAN + below(by_block.take(at_sum + at, axis=0), c_fan, row_fan, target)
        i = np.minimum(at, n - 1, out=at)
        out[k] = i

        points = (at_cover + a.take(i))[:, None] + to_longest
        flat_cover[points] = flat_cover.take(points) + (to_longest < length.take(i)[:, None])
        start = begin.take(i)
        np.cumsum(1 / flat_cover.take((at_cover + start)[:, None] + to_span), axis=1, out=prefix[:, 1:])
        low = first.take(i)
        places = np.minimum(low[:, None] + to_met, last.take(i)[:, None])
        events = places if in_order else order.take(places)
        shift, p = (row_prefix - start)[:, None], prefix.ravel()
        flat[at_leaf[:, None] + events] = np.maximum((p.take(b.take(events) + shift) - p.take(a.take(events) + shift)) / length.take(events), 1e-12)
        if in_order:
            block = low // FAN
            blocks = at_sum[:, None] + np.minimum(block[:, None] + to_block, sums.shape[1] - 1)
            tops_met = at_top[:, None] + np.minimum((block // FAN)[:, None] + to_sum, tops - 1)
        elif met * FAN < n:
            blocks, tops_met = at_sum[:, None] + events // FAN, at_top[:, None] + events // FAN**2
        else:
            np.sum(by_block, axis=1, out=flat_sums)
            np.sum(by_sum, axis=1, out=flat_top)
            continue
        flat_sums[blocks] = by_block.take(blocks, axis=0).sum(2)
        flat_top[tops_met] = by_sum.take(tops_met, axis=0).sum(2)

    rows, unique = np.ascontiguousarray(out.T), np.empty((lanes, n_samples))
    for t in range(lanes):
        p = np.concatenate([[0.0], np.cumsum(1 / np.maximum(cover[t, : len(grid)] - 1, 1))])
        unique[t] = (p[b[rows[t]]] - p[a[rows[t]]]) / length[rows[t]]
    return rows, unique


class SequentialDraw:
    """Draws by sequential bootstrap; many() makes those of several generators at once."""

    def __init__(self, t0: np.ndarray, t1: np.ndarray, weight: np.ndarray | None, fraction: float):
        self.t0, self.t1, self.weight, self.n = t0, t1, weight, max(1, int(len(t0) * fraction))

    def __call__(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        return next(self.many([rng]))

    def many(self, rngs: list[np.random.Generator]):
        parts = -(-len(rngs) * max(len(self.t0), self.n) // CELLS)
        for part in np.array_split(np.arange(len(rngs)), max(1, min(parts, len(rngs)))):
            for rows, unique in zip(*sequential_bootstraps(self.t0, self.t1, self.n, [rngs[t] for t in part])):
                yield rows, np.maximum(unique if self.weight is None else unique * self.weight[rows], 1e-12)


def sequential_draw(t0: np.ndarray, t1: np.ndarray, weight: np.ndarray | None, fraction: float) -> SequentialDraw:
    """Rows drawn by sequential bootstrap, weighted by their uniqueness in the draw."""
    return SequentialDraw(t0, t1, weight, fraction)


def uniform_draw(weight: np.ndarray):
    """Rows drawn evenly, with their weights."""

    def draw(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        rows = rng.integers(0, len(weight), len(weight))
        return rows, np.maximum(weight[rows], 1e-12)

    return draw
