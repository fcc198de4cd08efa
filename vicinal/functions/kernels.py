"""The metrics for all pairs of rows of two matrices, as ``metrics`` defines them for two.

Sums run over the coordinates one after another, as an expression does; what one row
alone decides is taken once a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

TINY = 1e-12
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _summed(a: np.ndarray, b: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    out, x, y = np.zeros((len(a), len(b))), a.T[:, :, None], np.ascontiguousarray(b.T)[:, None]
    for k in range(a.shape[1]):
        out += term(x[k], y[k])
    return out


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    d *= d
    return d


def _gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.abs(d, out=d)


def sqeuclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _summed(a, b, _square)


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(sqeuclidean(a, b))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _summed(a, b, _gap)


def chebyshev(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, np.ascontiguousarray(b.T), strict=True):
        np.maximum(out, _gap(x[:, None], y[None]), out=out)
    return out


def canberra(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def term(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        under = np.abs(x) + np.abs(y)
        return _gap(x, y) / np.where(under > 0, under, 1.0)

    return _summed(a, b, term)


def braycurtis(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return manhattan(a, b) / np.maximum(np.abs(a).sum(1)[:, None] + np.abs(b).sum(1)[None], TINY)


def _norm(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = _norm(a), _norm(b)
    out = np.maximum(1 - a @ b.T / (np.maximum(na, TINY)[:, None] * np.maximum(nb, TINY)[None]), 0)
    out[np.ix_(na < TINY, nb < TINY)] = 0
    return out


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (x - x.mean(1, keepdims=True) for x in (a, b))
    na, nb = _norm(a), _norm(b)
    out = 1 - np.clip(a @ b.T / (np.maximum(na, TINY)[:, None] * np.maximum(nb, TINY)[None]), -1, 1)
    out[np.ix_(na < TINY, nb < TINY)] = 0
    return out


def correlation_sqrt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2 * correlation(a, b))


def unit_mass(a: np.ndarray) -> np.ndarray:
    a = np.maximum(a, 0)
    mass = a.sum(1, keepdims=True)
    return np.where(mass > 0, a / np.where(mass > 0, mass, 1), 1 / max(a.shape[1], 1))


def jensenshannon(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = unit_mass(a), unit_mass(b)
    log = lambda x: np.log(np.maximum(x, TINY))
    out, lp, lq = np.zeros((len(a), len(b))), log(p), log(q)
    for x, y, lx, ly in zip(p.T, q.T, lp.T, lq.T, strict=True):
        x, lx = x[:, None], lx[:, None]
        middle = log((x + y) / 2)
        out += x * (lx - middle) + y * (ly - middle)
    return np.sqrt(np.maximum(out / 2, 0))


def wasserstein1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return manhattan(np.cumsum(unit_mass(a), 1)[:, :-1], np.cumsum(unit_mass(b), 1)[:, :-1])


def composite(parts: list[tuple[int, int, Kernel, float, float]]) -> Kernel:
    """A weighted sum of kernels on coordinates (start, stop, kernel, weight, scale)."""
    return lambda a, b: sum(w * f(a[:, i:j], b[:, i:j]) / s for i, j, f, w, s in parts)


def factors(parts: list[tuple[Kernel, float, float]], natural_scale: float) -> Kernel:
    """Of rows that hold the sizes of their views, and these one after another."""

    def fn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, at = np.zeros((len(a), len(b))), len(parts)
        for (f, weight, scale), size in zip(parts, a[0, : len(parts)].astype(int), strict=True):
            d = f(a[:, at : at + size], b[:, at : at + size]) / scale
            out, at = out + weight * d * d, at + size
        return np.sqrt(out) / natural_scale

    return fn
