"""Distance metrics as Column expressions over ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vicinal.functions import kernels

#: Norms and masses below this count as zero; logarithms are taken from here on.
TINY = 1e-12
Metric = Callable[[Column, Column], Column]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def l2_normalize(v: Column) -> Column:
    return scaled(v, F.greatest(norm(v), F.lit(TINY)))


def center(v: Column) -> Column:
    m = mean(v)
    return F.transform(v, lambda x: x - m)


def unit_mass(v: Column) -> Column:
    """Negative entries are 0, the rest sums to 1; no mass at all is uniform."""
    pos = F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    mass = total(pos)
    return F.transform(pos, lambda x: F.when(mass > 0, x / mass).otherwise(1.0 / F.size(v)))


def image_masses(v: Column) -> Column:
    """Like ``unit_mass``, but an image without mass is an error."""
    pos = F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    return F.when(total(pos) > 0, unit_mass(v)).otherwise(F.raise_error(F.lit("an image has no mass")).cast("array<double>"))


def cumulative(v: Column) -> Column:
    empty = F.array().cast("array<double>")
    step = lambda s, x: F.concat(s, F.array(x + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0))))
    return F.aggregate(v, empty, step)


def sqeuclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    """Exact; no floor at contact."""
    return F.sqrt(sqeuclidean(a, b))


def cosine(a: Column, b: Column) -> Column:
    na, nb = norm(a), norm(b)
    both = (na < TINY) & (nb < TINY)
    return F.when(both, 0.0).otherwise(F.greatest(1.0 - dot(a, b) / (F.greatest(na, F.lit(TINY)) * F.greatest(nb, F.lit(TINY))), F.lit(0.0)))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def canberra(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        under = F.abs(x) + F.abs(y)
        return F.when(under > 0, F.abs(x - y) / under).otherwise(0.0)

    return total(F.zip_with(a, b, term))


def braycurtis(a: Column, b: Column) -> Column:
    """Over |x| + |y|, also for signed data."""
    return manhattan(a, b) / F.greatest(total(F.zip_with(a, b, lambda x, y: F.abs(x) + F.abs(y))), F.lit(TINY))


def jensenshannon(a: Column, b: Column) -> Column:
    p, q = unit_mass(a), unit_mass(b)
    log = lambda x: F.ln(F.greatest(x, F.lit(TINY)))
    kl = lambda x, y: total(F.zip_with(x, F.zip_with(x, y, lambda s, t: (s + t) / 2), lambda s, m: s * (log(s) - log(m))))
    return F.sqrt(F.greatest((kl(p, q) + kl(q, p)) / 2, F.lit(0.0)))


def wasserstein1d(a: Column, b: Column) -> Column:
    """L1 between the running sums of the unit masses (the last is 1 for both)."""
    return manhattan(F.slice(cumulative(unit_mass(a)), F.lit(1), F.size(a) - 1), F.slice(cumulative(unit_mass(b)), F.lit(1), F.size(b) - 1))


def correlation(a: Column, b: Column) -> Column:
    x, y = center(a), center(b)
    nx, ny = norm(x), norm(y)
    r = dot(x, y) / (F.greatest(nx, F.lit(TINY)) * F.greatest(ny, F.lit(TINY)))
    return F.when((nx < TINY) & (ny < TINY), 0.0).otherwise(1.0 - F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def correlation_sqrt(a: Column, b: Column) -> Column:
    return F.sqrt(2 * correlation(a, b))


def part(v: Column, start: int, stop: int) -> Column:
    return F.slice(v, start + 1, stop - start)


def composite(blocks: list[tuple[int, int, str, float]], scales: list[float] | None = None) -> Metric:
    """Weighted sum of metrics on coordinate slices (start, stop, name, weight)."""
    own = scales or [1.0] * len(blocks)

    def fn(a: Column, b: Column) -> Column:
        out = F.lit(0.0)
        for (i, j, name, w), s in zip(blocks, own, strict=True):
            out = out + w * METRICS[name].fn(part(a, i, j), part(b, i, j)) / max(s, TINY)
        return out

    return fn


def direction(v: Column, p: int = 2) -> Column:
    size = norm(v) if p == 2 else total(F.transform(v, F.abs))
    return scaled(v, F.greatest(size, F.lit(TINY)))


def log_size(v: Column, p: int = 2) -> Column:
    size = norm(v) if p == 2 else total(F.transform(v, F.abs))
    return F.array(F.ln(F.greatest(size, F.lit(TINY))))


@dataclass(frozen=True)
class Factor:
    """A named view with a metric of its own; ``role`` is primary, modulator, gain or axis."""

    name: str
    view: Callable[[Column], Column]
    metric: str = "l2"
    role: str = "primary"
    weight: float | None = 1.0
    scale: float = 1.0
    anchors: int = 64


def scale_quotient(p: int = 2, shape_weight: float = 1.0, size_weight: float = 1.0) -> list[Factor]:
    """Direction and logarithmic size as two factors."""
    return [Factor("shape", lambda v: direction(v, p), "l2", "primary", shape_weight), Factor("size", lambda v: log_size(v, p), "l2", "modulator", size_weight)]


def validate_factors(factors: list[Factor]) -> list[str]:
    """Warnings about a list of factors."""
    out = []
    if sum(f.role == "primary" for f in factors) != 1:
        out.append("exactly one factor should be primary")
    out += [f"factor {f.name} has weight 0" for f in factors if f.weight == 0]
    return out


def factor_metric(factors: list[Factor], natural_scale: float = 1.0) -> Metric:
    """sqrt of the weighted sum of squared scaled distances over views."""

    def fn(a: Column, b: Column) -> Column:
        out = F.lit(0.0)
        for f in factors:
            if f.weight:
                d = METRICS[f.metric].fn(f.view(a), f.view(b)) / f.scale
                out = out + f.weight * d * d
        return F.sqrt(out) / natural_scale

    return fn


@dataclass(frozen=True)
class MetricSpec:
    """A metric with what may be assumed of it. ``to_l2``: a view under which
    its order is that of the Euclidean distance, if there is one. ``kernel`` gives the
    same for all pairs of rows of two matrices, of rows that went through ``prepare``."""

    name: str
    fn: Metric
    to_l2: Callable[[Column], Column] | None = None
    is_true_metric: bool = True
    natural_scale: float = 1.0
    kernel: kernels.Kernel | None = None
    prepare: Callable[[Column], Column] | None = None

    def __call__(self, a: Column, b: Column) -> Column:
        return self.fn(a, b) / self.natural_scale


METRICS = {
    m.name: m
    for m in (
        MetricSpec("l2", euclidean, lambda v: v, kernel=kernels.euclidean),
        MetricSpec("sqeuclidean", sqeuclidean, lambda v: v, False, kernel=kernels.sqeuclidean),
        MetricSpec("cosine", cosine, l2_normalize, False, kernel=kernels.cosine),
        MetricSpec("l1", manhattan, kernel=kernels.manhattan),
        MetricSpec("linf", chebyshev, kernel=kernels.chebyshev),
        MetricSpec("canberra", canberra, kernel=kernels.canberra),
        MetricSpec("braycurtis", braycurtis, None, False, kernel=kernels.braycurtis),
        MetricSpec("jensenshannon", jensenshannon, kernel=kernels.jensenshannon),
        MetricSpec("wasserstein1d", wasserstein1d, kernel=kernels.wasserstein1d),
        MetricSpec("correlation", correlation, lambda v: l2_normalize(center(v)), False, kernel=kernels.correlation),
        MetricSpec("correlation_sqrt", correlation_sqrt, lambda v: l2_normalize(center(v)), kernel=kernels.correlation_sqrt),
        MetricSpec("frobenius", euclidean, lambda v: v, kernel=kernels.euclidean),
    )
}


def composite_spec(blocks: list[tuple[int, int, str, float]], scales: list[float] | None = None) -> MetricSpec:
    """``composite`` with its kernel."""
    own = scales or [1.0] * len(blocks)
    parts = [(i, j, METRICS[name].kernel, w, max(s, TINY)) for (i, j, name, w), s in zip(blocks, own, strict=True)]
    return MetricSpec("composite", composite(blocks, scales), kernel=kernels.composite(parts))


def factor_spec(factors: list[Factor], natural_scale: float = 1.0) -> MetricSpec:
    """``factor_metric`` with its kernel: a row's views are made once, one after another
    behind their sizes."""
    used = [f for f in factors if f.weight]
    parts = [(METRICS[f.metric].kernel, f.weight, f.scale) for f in used]

    def prepare(v: Column) -> Column:
        views = [f.view(v) for f in used]
        return F.concat(F.array(*(F.size(x).cast("double") for x in views)), *views)

    return MetricSpec("factors", factor_metric(factors, natural_scale), kernel=kernels.factors(parts, natural_scale), prepare=prepare)


def get_metric(name: str, fn: Metric | None = None, whitening: list[list[float]] | None = None) -> MetricSpec:
    """A built-in by name, ``custom`` with a Column function, or ``mahalanobis``
    with a whitening matrix W (the distance is the Euclidean one of x W)."""
    if name == "custom":
        if fn is None:
            raise ValueError("a custom metric needs fn")
        return MetricSpec("custom", fn)
    if name == "mahalanobis":
        if whitening is None:
            raise ValueError("mahalanobis needs a whitening matrix")
        cols = [F.array(*(F.lit(float(row[k])) for row in whitening)) for k in range(len(whitening[0]))]
        view = lambda v: F.array(*(dot(v, c) for c in cols))
        return MetricSpec("mahalanobis", lambda a, b: euclidean(view(a), view(b)), view)
    if name not in METRICS:
        raise KeyError(f"no metric is named {name!r}; there are {sorted(METRICS)}")
    return METRICS[name]
