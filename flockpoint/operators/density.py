"""Densities and gradients of a kernel sum over the points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.points import as_points, dim_of
from .blocks import BlockIndex, point_pairs, walk_pairs, within
from .neighbours import index_of, neighbour_counts

ERROR = 1e-16  # what all left-out terms of a sum may come to together


def reach(s: float, n_rows: int, error: float = ERROR) -> float:
    """The distance beyond which the gaussian terms of ``n_rows`` rows sum to at most ``error``."""
    return s * math.sqrt(max(2.0 * math.log(max(n_rows, 1) / error), 0.0))


def _kernel_sums(targets: BlockIndex, data: BlockIndex, radius: float, influence) -> DataFrame:
    dim = data.dim
    leaves, _ = walk_pairs(targets, data, within(radius))
    near = point_pairs(targets.points, data.points, leaves, dim, radius, ["pid"], ["w"])
    near = near.withColumn("k", influence(F.col("dist")) * F.col("q_w"))
    steps = [F.sum(F.col("k") * (F.col("q_features")[i] - F.col("p_features")[i])) for i in range(dim)]
    sums = near.groupBy(F.col("p_pid").alias("pid")).agg(F.sum("k").alias("density"), F.array(*steps).alias("gradient"))
    zero = F.array(*[F.lit(0.0)] * dim)
    return (
        targets.points.select("pid")
        .join(sums, "pid", "left")
        .select("pid", F.coalesce("density", F.lit(0.0)).alias("density"), F.coalesce("gradient", zero).alias("gradient"))
    )


def gaussian_density(
    points: DataFrame | BlockIndex, s: float, targets: DataFrame | None = None, error: float = ERROR
) -> DataFrame:
    """``(id, density, gradient)`` of the gaussian kernel sum at each row (or target row).

    Point pairs are met block by block and summed before the shuffle. Pairs are left out where the terms
    of the whole table could not add more than ``error`` to a density.
    """
    data = index_of(points)
    at = data if targets is None else index_of(targets)
    scale = F.lit(2.0 * s * s)
    return at.spread(_kernel_sums(at, data, reach(s, data.n_rows, error), lambda d: F.exp(-(d * d) / scale)))


def square_wave_density(points: DataFrame | BlockIndex, s: float) -> DataFrame:
    """``(id, density)``: rows within ``s``, counted through whole blocks."""
    return neighbour_counts(points, s).select("id", F.col("n_neigh").alias("density"))


def square_wave_gradient(points: DataFrame | BlockIndex, s: float, targets: DataFrame | None = None) -> DataFrame:
    """``(id, density, gradient)``: sum of the offsets to the rows within ``s``."""
    data = index_of(points)
    at = data if targets is None else index_of(targets)
    return at.spread(_kernel_sums(at, data, s, lambda d: F.lit(1.0)))


def density_table(points: DataFrame | BlockIndex, s: float, xi: float) -> DataFrame:
    """``(id, density, significant)``."""
    return gaussian_density(points, s).select("id", "density", (F.col("density") >= F.lit(xi)).alias("significant"))


def lattice(points: DataFrame, steps: int, margin: float = 1.0) -> DataFrame:
    """A ``steps`` x ``steps`` lattice over the box of 2-D points, widened by ``margin``."""
    if dim_of(points) != 2:
        raise ValueError("a lattice is drawn for 2-D points")
    x = F.col("features")
    row = points.agg(F.min(x[0]), F.min(x[1]), F.max(x[0]), F.max(x[1])).first()
    lo, hi = [v - margin for v in row[:2]], [v + margin for v in row[2:]]
    gap = [(h - l) / (steps - 1) for l, h in zip(lo, hi)]
    nodes = points.sparkSession.range(steps * steps)
    ix, iy = F.floor(F.col("id") / steps), F.pmod(F.col("id"), F.lit(steps))
    return as_points(nodes, "id", [F.lit(lo[0]) + ix * F.lit(gap[0]), F.lit(lo[1]) + iy * F.lit(gap[1])])


def density_grid(points: DataFrame, s: float, prec: int = 3, margin: float = 1.0) -> DataFrame:
    """``(id, x, y, density)`` on a lattice of ``10 prec`` steps per axis."""
    grid = lattice(points, 10 * prec, margin)
    sums = gaussian_density(points, s, targets=grid)
    return sums.join(grid, "id").select("id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"), "density")
