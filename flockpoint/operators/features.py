"""Clustering features (count, linear sum, square sum): they add, so every merge is an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut, numbered
from ..sources.points import dim_of
from .cells import near_cells


def features_by(points: DataFrame, *keys: str) -> DataFrame:
    """``(keys..., n, ls, ss)`` of each group; partial sums are made before the shuffle."""
    dim = dim_of(points)
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        V.per_dim(F.sum, "features", dim).alias("ls"),
        F.sum(V.dot("features", "features", dim)).alias("ss"),
    )


def merge_features(cfs: DataFrame, *keys: str) -> DataFrame:
    """Add features that share the keys."""
    dim = dim_of(cfs, "ls") if cfs.schema["ls"].metadata.get("dim") else _dim(cfs)
    return cfs.groupBy(*keys).agg(F.sum("n").alias("n"), V.per_dim(F.sum, "ls", dim).alias("ls"), F.sum("ss").alias("ss"))


def _dim(cfs: DataFrame) -> int:
    return cfs.select(F.size("ls").alias("d")).first()["d"]


def clustering_features(points: DataFrame, side: float, origin: list[float] | None = None) -> DataFrame:
    """Features of the grid cells of the given side: ``(cell, n, ls, ss)``."""
    origin = origin or [0.0] * dim_of(points)
    return features_by(points.withColumn("cell", V.cell_of("features", origin, side)), "cell")


def coarser(cfs: DataFrame, ratio: int) -> DataFrame:
    """Features on cells ``ratio`` times as wide: exact, because features add."""
    wide = F.transform("cell", lambda c: F.floor(c / F.lit(ratio)).cast("bigint"))
    return merge_features(cfs.withColumn("cell", wide), "cell")


def grow_threshold(points: DataFrame, diameter: float, growth: float = 1.5, max_entries: int = 500):
    """Widen the diameter by ``growth`` until at most ``max_entries`` cells remain.

    Returns the features and the diameter reached. The cell side is diameter / sqrt(dim),
    so no cell can exceed the diameter. Each step re-aggregates the points' finest
    features only when the ratio of the sides is whole, otherwise the points.
    """
    dim = dim_of(points)
    while True:
        cfs = cut(clustering_features(points, diameter / dim**0.5))
        if cfs.limit(max_entries + 1).count() <= max_entries:
            return cfs, diameter
        diameter *= growth


def absorb(cfs: DataFrame, threshold: float) -> DataFrame:
    """Merge neighbouring cells until no merged diameter stays within ``threshold``.

    In each round the pairs that are one another's best partner merge; the entry keeps
    the smaller cell as its name. Equal diameters are told apart by a hash of the pair, so that
    many pairs of a regular grid merge at once; the best pair of all always does.
    """
    dim = _dim(cfs)
    cur = cut(cfs)
    while True:
        a = cur.select("cell", F.col("cell").alias("a"), F.struct("n", "ls", "ss").alias("x"))
        b = cur.select("cell", F.struct("n", "ls", "ss").alias("y"))
        pairs = near_cells(a, b, ["a", "x"], 1).filter(F.col("a") != F.col("cell"))
        n = F.col("x.n") + F.col("y.n")
        ls = F.array(*[F.col("x.ls")[i] + F.col("y.ls")[i] for i in range(dim)])
        pairs = pairs.select(
            "a", F.col("cell").alias("b"), V.cf_diameter(n, ls, F.col("x.ss") + F.col("y.ss")).alias("diameter")
        ).filter(F.col("diameter") <= F.lit(threshold))
        best = pairs.groupBy("a").agg(
            F.min(F.struct("diameter", F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("h"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("p")
        )
        both = best.groupBy("p.lo", "p.hi").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 2)
        moves = cut(both.select(F.col("hi").alias("cell"), F.col("lo").alias("into")))
        if moves.isEmpty():
            return cur
        moved = cur.join(moves, "cell", "left").withColumn("cell", F.coalesce("into", "cell")).drop("into")
        cur = cut(merge_features(moved, "cell"))


def leaf_entries(cfs: DataFrame) -> DataFrame:
    """``(entry, n, centroid, diameter)`` numbered by cell."""
    rows, _, _ = numbered(cfs, F.col("cell"), name="entry")
    return rows.select(
        "entry", "n", V.centre_of("ls", "n").alias("centroid"), V.cf_diameter("n", "ls", "ss").alias("diameter")
    )
