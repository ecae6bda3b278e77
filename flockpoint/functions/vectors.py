"""Vector and scalar expressions over ``ARRAY<DOUBLE>`` columns.

Every function takes and returns Columns. When the dimension is known and small the
sums are written out term by term, which keeps them inside generated code; otherwise
they fall back to higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL_LIMIT = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum_terms(a, b, term: Callable[[Column, Column], Column], dim: int | None) -> Column:
    a, b = _col(a), _col(b)
    if dim is not None and 0 < dim <= UNROLL_LIMIT:
        return reduce(lambda x, y: x + y, [term(a[i], b[i]) for i in range(dim)])
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b, dim: int | None = None) -> Column:
    return _sum_terms(a, b, lambda x, y: x * y, dim)


def sqeuclidean(a, b, dim: int | None = None) -> Column:
    return _sum_terms(a, b, lambda x, y: (x - y) * (x - y), dim)


def euclidean(a, b, dim: int | None = None) -> Column:
    return F.sqrt(sqeuclidean(a, b, dim))


def manhattan(a, b, dim: int | None = None) -> Column:
    return _sum_terms(a, b, lambda x, y: F.abs(x - y), dim)


def chebyshev(a, b, dim: int | None = None) -> Column:
    a, b = _col(a), _col(b)
    if dim is not None and 1 < dim <= UNROLL_LIMIT:
        return F.greatest(*[F.abs(a[i] - b[i]) for i in range(dim)])
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine_similarity(a, b, dim: int | None = None) -> Column:
    return dot(a, b, dim) / (F.sqrt(dot(a, a, dim)) * F.sqrt(dot(b, b, dim)))


def cosine_distance(a, b, dim: int | None = None) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b, dim)


METRICS: dict[str, Callable] = {
    "euclidean": euclidean,
    "sqeuclidean": sqeuclidean,
    "manhattan": manhattan,
    "chebyshev": chebyshev,
    "cosine": cosine_distance,
}


def metric(name: str | Callable[[Column, Column], Column], dim: int | None = None) -> Callable[[Column, Column], Column]:
    """A distance by name, or the caller's own function of two Columns."""
    if callable(name):
        return name
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; choose one of {sorted(METRICS)}")
    fn = METRICS[name]
    return lambda a, b: fn(a, b, dim)


def gaussian_influence(a, b, s: float, dim: int | None = None) -> Column:
    return F.exp(-sqeuclidean(a, b, dim) / F.lit(2.0 * s * s))


def square_wave_influence(a, b, s: float, dim: int | None = None) -> Column:
    return F.when(euclidean(a, b, dim) <= F.lit(float(s)), 1).otherwise(0)


def chernoff_sample_size(u_min, f, n, d) -> Column:
    """Rows to sample so that a cluster of ``u_min`` rows keeps a share ``f`` with risk ``d``."""
    u_min, f, n, d = (c if isinstance(c, Column) else F.lit(float(c)) for c in (u_min, f, n, d))
    risk = F.log(F.lit(1.0) / d)
    return f * n + n / u_min * risk + n / u_min * F.sqrt(risk * risk + F.lit(2.0) * f * u_min * risk)


def shrink(point, centre, alpha: float) -> Column:
    """Move a point the share ``alpha`` of the way to ``centre``."""
    return F.zip_with(_col(point), _col(centre), lambda p, c: p + F.lit(float(alpha)) * (c - p))


def edge_weight(dist, floor: float = 1e-12) -> Column:
    """1/d; distances below ``floor`` count as ``floor`` so that copies stay finite."""
    return F.lit(1.0) / F.greatest(_col(dist), F.lit(floor))


def edge_similarity(dist, floor: float = 1e-12) -> Column:
    return F.floor(edge_weight(dist, floor) * F.lit(1e4)).cast("bigint")


def cell_of(features, origin: list[float], side: float) -> Column:
    features = _col(features)
    return F.array(
        *[F.floor((features[i] - F.lit(float(o))) / F.lit(float(side))).cast("bigint") for i, o in enumerate(origin)]
    )


def cell_low(cell, origin: list[float], side: float) -> Column:
    cell = _col(cell)
    return F.array(*[F.lit(float(o)) + cell[i] * F.lit(float(side)) for i, o in enumerate(origin)])


def in_box(features, low: list[float], high: list[float]) -> Column:
    """Strictly inside an axis-parallel box."""
    features = _col(features)
    tests = [(features[i] > F.lit(float(a))) & (features[i] < F.lit(float(b))) for i, (a, b) in enumerate(zip(low, high))]
    return reduce(lambda x, y: x & y, tests)


def scale(a, factor) -> Column:
    return F.transform(_col(a), lambda v: v * factor)


def centre_of(linear_sum, n) -> Column:
    n = _col(n)
    return F.transform(_col(linear_sum), lambda v: v / n)


def hill_step(point, gradient, delta) -> Column:
    """Walk ``delta`` along the gradient; stay put where the gradient vanishes."""
    gradient = _col(gradient)
    delta = delta if isinstance(delta, Column) else F.lit(float(delta))
    norm = F.sqrt(dot(gradient, gradient))
    moved = F.zip_with(_col(point), gradient, lambda p, g: p + delta * g / norm)
    return F.when(norm > 0, moved).otherwise(_col(point))


def round_vector(a, digits: int = 1) -> Column:
    return F.transform(_col(a), lambda v: F.round(v, digits))


def cf_sse(n, ls, ss) -> Column:
    """Sum of squared distances to the centroid from count, linear and square sum."""
    n, ls, ss = _col(n), _col(ls), _col(ss)
    return F.greatest(ss - dot(ls, ls) / n, F.lit(0.0))


def cf_diameter(n, ls, ss) -> Column:
    """Root of the mean squared distance over ordered pairs of members."""
    n, ls, ss = _col(n), _col(ls), _col(ss)
    spread = F.greatest(F.lit(2.0) * n * ss - F.lit(2.0) * dot(ls, ls), F.lit(0.0))
    return F.when(n > 1, F.sqrt(spread / (n * (n - 1)))).otherwise(F.lit(0.0))


def flatten(nested) -> Column:
    return F.flatten(_col(nested))


def per_dim(fn: Callable[[Column], Column], features, dim: int) -> Column:
    """An array holding one aggregate per coordinate."""
    features = _col(features)
    return F.array(*[fn(features[i]) for i in range(dim)])


def box_gap2(alo, ahi, blo, bhi, dim: int) -> Column:
    """Squared distance between two boxes (0 when they meet)."""
    alo, ahi, blo, bhi = map(_col, (alo, ahi, blo, bhi))
    zero = F.lit(0.0)
    gaps = [F.greatest(zero, blo[i] - ahi[i], alo[i] - bhi[i]) for i in range(dim)]
    return reduce(lambda x, y: x + y, [g * g for g in gaps])


def box_span2(alo, ahi, blo, bhi, dim: int) -> Column:
    """Squared distance between the farthest points of two boxes."""
    alo, ahi, blo, bhi = map(_col, (alo, ahi, blo, bhi))
    spans = [F.greatest(ahi[i] - blo[i], bhi[i] - alo[i]) for i in range(dim)]
    return reduce(lambda x, y: x + y, [s * s for s in spans])
