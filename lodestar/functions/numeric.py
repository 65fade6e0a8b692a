"""Small statistics on bounded arrays: normality, isolation trees, variance inflation."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation (AS R94), for 4 to 5000 values; constant values give (1, 1)."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 4 or x[-1] - x[0] < 1e-12:
        return 1.0, 1.0
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, norm = 1 / np.sqrt(n), float(m @ m)
    a = np.empty(n)
    last = m[-1] / np.sqrt(norm) + _poly((0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), u)
    if n > 5:
        second = m[-2] / np.sqrt(norm) + _poly((0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
        phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a[2:-2] = m[2:-2] / np.sqrt(phi)
        a[[-2, 1]] = second, -second
    else:
        phi = (norm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / np.sqrt(phi)
    a[[-1, 0]] = last, -last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if w >= 1:
        return 1.0, 1.0
    y = np.log(1 - w)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 0.0
        z = (-np.log(gamma - y) - _poly((0.544, -0.39978, 0.025054, -6.714e-4), n)) / np.exp(_poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        size = np.log(n)
        z = (y - _poly((-1.5861, -0.31082, -0.083751, 0.0038915), size)) / np.exp(_poly((-0.4803, -0.082676, 0.0030302), size))
    return w, 1 - normal.cdf(float(z))


def omnibus(n: Column, skewness: Column, kurtosis: Column) -> Column:
    """D'Agostino and Pearson's K2 of ``n`` values by their population skewness and excess kurtosis; chi-squared with two degrees of freedom for normal ones."""
    y = skewness * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    scaled = y / F.sqrt(2 / (w2 - 1))
    z_skewness = F.log(F.abs(scaled) + F.sqrt(scaled * scaled + 1)) / F.sqrt(F.log(w2) / 2)  # its sign goes with the square
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurtosis + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(spread)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    z_kurtosis = (1 - 2 / (9 * a) - F.cbrt(F.try_divide(1 - 2 / a, 1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return z_skewness * z_skewness + z_kurtosis * z_kurtosis


def variance_inflation(r: np.ndarray) -> np.ndarray:
    """The diagonal of the inverse of a correlation matrix; infinite where R² is 0.999 or more."""
    vif = np.diag(np.linalg.pinv(r))
    exact = np.linalg.matrix_rank(r, tol=1e-8) < len(r)
    return np.where((vif >= 1000) | (exact & (vif > 0) & (np.abs(r - np.eye(len(r))).max(axis=0) > 0.9995)), np.inf, np.maximum(vif, 1.0))


@dataclass
class IsolationTrees:
    """feature (-1 at leaves), cut, first child and path length, one row for each tree."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    path: np.ndarray
    usual: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, child, path in zip(self.feature, self.cut, self.child, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            while (feature[node] >= 0).any():
                f = feature[node]
                node = np.where(f >= 0, child[node] + (x[rows, np.maximum(f, 0)] >= cut[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else float(2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n)


def isolation_trees(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> IsolationTrees:
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(sample, 2))))
    grown = []
    for _ in range(trees):
        nodes = [[-1.0, 0.0, 0.0, 0.0]]
        stack = [(0, rng.choice(len(x), sample, replace=False), 0)]
        while stack:
            at, rows, depth = stack.pop()
            part = x[rows]
            wide = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
            if depth == limit or not len(wide):
                nodes[at] = [-1.0, 0.0, 0.0, depth + average_path(len(rows))]
                continue
            f = int(rng.choice(wide))
            low, high = part[:, f].min(), part[:, f].max()
            cut = low + (high - low) * (1 - rng.random())
            right = part[:, f] >= cut
            nodes[at] = [f, cut, len(nodes), 0.0]
            stack += [(len(nodes), rows[~right], depth + 1), (len(nodes) + 1, rows[right], depth + 1)]
            nodes += [[-1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0]]
        grown.append(nodes)
    size = max(map(len, grown))
    grid = np.array([g + [[-1.0, 0.0, 0.0, 0.0]] * (size - len(g)) for g in grown])
    return IsolationTrees(grid[..., 0].astype(int), grid[..., 1], grid[..., 2].astype(int), grid[..., 3], average_path(sample))
