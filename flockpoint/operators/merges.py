"""Reading a table of merge scores ``(n_clusters, score)``: heights, jumps, the best count.

The tables here have one row per merge of a bounded number of clusters, so ordering them
as a whole is cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dendrogram_heights(scores: DataFrame) -> DataFrame:
    """``(n_clusters, score, height)``: running sum of 1 / score from many clusters to few."""
    run = W.orderBy(F.col("n_clusters").desc()).rowsBetween(W.unboundedPreceding, 0)
    return scores.select("n_clusters", "score", F.sum(F.lit(1.0) / F.col("score")).over(run).alias("height"))


def height_steps(heights: DataFrame) -> DataFrame:
    """``(pos, n_clusters, height, prev)`` over the upper half of the merges.

    The first compared value is the height one past the middle, and the scan itself starts
    at the middle.
    """
    order = W.orderBy(F.col("n_clusters").desc())
    whole = W.partitionBy()
    pos = heights.withColumn("pos", F.row_number().over(order) - 1).withColumn("m", F.count(F.lit(1)).over(whole))
    half = F.floor(F.col("m") / 2)
    start = F.max(F.when(F.col("pos") == half + 1, F.col("height"))).over(whole)
    prev = F.lag("height").over(order)
    return pos.withColumn("prev", F.when(F.col("pos") == half, start).otherwise(prev)).filter(F.col("pos") >= half)


def bigger_jump(heights: DataFrame, jump: float | object) -> DataFrame:
    """The first step higher than ``jump``: its middle as ``(cutoff)``; no row when there is none."""
    limit = jump if not isinstance(jump, (int, float)) else F.lit(float(jump))
    steps = height_steps(heights).filter(F.col("height") - F.col("prev") > limit)
    first = steps.agg(F.min(F.struct("pos", "prev", "height")).alias("s")).filter(F.col("s").isNotNull())
    return first.select((F.col("s.prev") + (F.col("s.height") - F.col("s.prev")) / 2).alias("cutoff"))


def jump_cutoff(heights: DataFrame, mult: float = 1000, eta: float = 2) -> DataFrame:
    """``(cutoff)``: the first step above ``mult / eta^j`` times the mean upper height.

    The mean is taken over the heights after the first, up to the middle.
    ``j`` is the smallest whole number for which a step qualifies, taken in closed form
    from the largest step instead of by trial.
    """
    whole = W.partitionBy()
    order = W.orderBy(F.col("n_clusters").desc())
    m = F.count(F.lit(1)).over(whole)
    upper = (
        heights.withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("m", m)
        .filter((F.col("pos") >= 1) & (F.col("pos") <= F.bround(F.col("m") / 2)))
        .agg(F.avg("height").alias("avg"))
    )
    steps = height_steps(heights).withColumn("diff", F.col("height") - F.col("prev"))
    top = steps.agg(F.max("diff").alias("top")).filter(F.col("top") > 0)
    ratio = F.lit(float(mult)) * F.col("avg") / F.col("top")
    j = F.greatest(F.lit(0.0), F.floor(F.log(ratio) / F.lit(_ln(eta))) + 1)
    limit = F.lit(float(mult)) / F.pow(F.lit(float(eta)), j) * F.col("avg")
    bound = top.withColumn("__k", F.lit(1)).join(upper.withColumn("__k", F.lit(1)), "__k").select("__k", limit.alias("limit"))
    hit = steps.withColumn("__k", F.lit(1)).join(bound, "__k").filter(F.col("diff") > F.col("limit"))
    first = hit.agg(F.min(F.struct("pos", "prev", "height")).alias("s")).filter(F.col("s").isNotNull())
    return first.select((F.col("s.prev") + (F.col("s.height") - F.col("s.prev")) / 2).alias("cutoff"))


def _ln(x: float) -> float:
    import math

    return math.log(x)


def nearest_height(heights: DataFrame, cutoff: DataFrame) -> DataFrame:
    """``(n_clusters)`` of the lowest height at or above the cutoff."""
    at = heights.withColumn("__k", F.lit(1)).join(cutoff.withColumn("__k", F.lit(1)), "__k")
    return at.filter(F.col("height") >= F.col("cutoff")).agg(F.min_by("n_clusters", "height").alias("n_clusters"))


def optimal_n_clusters(scores: DataFrame, mult: float = 1000, eta: float = 2) -> DataFrame:
    """``(n_clusters)``; NULL with three merges or fewer, or when no height stands out."""
    heights = dendrogram_heights(scores)
    best = nearest_height(heights, jump_cutoff(heights, mult, eta))
    n = scores.agg(F.count(F.lit(1)).alias("n")).withColumn("__k", F.lit(1))
    return n.join(best.withColumn("__k", F.lit(1)), "__k", "left").select(
        F.when(F.col("n") > 3, F.col("n_clusters")).alias("n_clusters")
    )
