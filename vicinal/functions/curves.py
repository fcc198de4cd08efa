"""The membership curve of a map: 1 / (1 + a d ** (2 b)) fitted to a gap and a decay."""

from __future__ import annotations

import numpy as np

#: Points of the fit, over three spreads.
POINTS = 300


def fit_curve(spread: float = 1.0, min_dist: float = 0.1) -> tuple[float, float]:
    """(a, b) by damped least squares against 1 up to ``min_dist`` and exp(-(x -
    min_dist) / spread) beyond it. For b below 1 near pairs are pulled ever harder."""
    x = np.linspace(0, 3 * spread, POINTS)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    error = lambda p: 1 / (1 + np.exp(p[0] + 2 * np.exp(p[1]) * np.log(x))) - y
    p, damp = np.zeros(2), 1e-3
    r = error(p)
    for _ in range(200):
        q = r + y
        grad = -q * (1 - q)
        j = np.stack([grad, grad * 2 * np.exp(p[1]) * np.log(x)], 1)
        h = j.T @ j
        step = np.linalg.solve(h + damp * np.diag(np.diag(h)) + 1e-15 * np.eye(2), -j.T @ r)
        new = error(p + step)
        if new @ new < r @ r:
            done = np.abs(step).max() < 1e-12
            p, r, damp = p + step, new, max(damp / 5, 1e-12)
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    return float(np.exp(p[0])), float(np.exp(p[1]))


def least_gap(b: float = 1.0, spread: float = 1.0) -> float:
    """The smallest ``min_dist`` whose fitted b reaches ``b``; at most two spreads."""
    low, high = 0.0, 0.25 * spread
    while fit_curve(spread, high)[1] < b:
        high *= 2
        if high > 2 * spread:
            return 2 * spread
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if fit_curve(spread, mid)[1] < b else (low, mid)
    return high
