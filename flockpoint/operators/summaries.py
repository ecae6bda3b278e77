"""Per-cluster summaries, linkage between clusters, and scattered representatives.

Input tables are labelled points ``(id, features, label)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import attach, cut
from ..sources.points import dim_of, with_dim
from .blocks import block_index, point_pairs, walk_pairs
from .features import features_by

LINKAGES = ("single", "complete", "average", "ward")


def check_linkage(linkage: str) -> str:
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage!r}; choose one of {LINKAGES}")
    return linkage


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def largest_cluster(labels: DataFrame) -> DataFrame:
    return cluster_sizes(labels).agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("b")).select(
        (-F.col("b.neg")).alias("label"), "b.n"
    )


def members(labels: DataFrame, label: int) -> DataFrame:
    return labels.filter(F.col("label") == label)


def bounding_boxes(points: DataFrame, *keys: str) -> DataFrame:
    dim = dim_of(points)
    return points.groupBy(*keys).agg(
        V.per_dim(F.min, "features", dim).alias("low"), V.per_dim(F.max, "features", dim).alias("high")
    )


def label_means(points: DataFrame) -> DataFrame:
    """``(label, centre)``: mean position per label (also used for attractors)."""
    return points.groupBy("label").agg(V.per_dim(F.avg, "features", dim_of(points)).alias("centre"))


def cluster_sse(points: DataFrame) -> DataFrame:
    """``(label, n, centroid, sse)``: two passes, so that large offsets lose no digits."""
    dim = dim_of(points)
    centres = points.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), V.per_dim(F.avg, "features", dim).alias("centroid")
    )
    return (
        attach(points.select("id", "features", "label"), centres, "label", "n")
        .groupBy("label", "n", "centroid")
        .agg(F.sum(V.sqeuclidean("features", "centroid", dim)).alias("sse"))
    )


def total_sse(points: DataFrame) -> DataFrame:
    return cluster_sse(points).agg(F.sum("sse").alias("total_sse"))


def linkage_distance(points: DataFrame, linkage: str) -> DataFrame:
    """``(ci, cj, dist)``, ci < cj: least, greatest or mean distance over the pairs of members.

    The definition runs over all pairs of two clusters. They are met block by block and
    folded before the shuffle; no pair is written.
    """
    check_linkage(linkage)
    if linkage == "ward":
        return ward_increments(points).select("ci", "cj", F.col("increment").alias("dist"))
    fold = {"single": F.min, "complete": F.max, "average": F.sum}[linkage]
    base = points.select("id", "features")
    ix = block_index(with_dim(base, dim_of(points)))
    tagged = ix.copies().join(points.select("id", "label"), "id")
    per = tagged.groupBy("pid", "label").agg(F.count(F.lit(1)).alias("lw"))
    pts = ix.points.join(per, "pid")
    leaves, _ = walk_pairs(ix, ix, F.lit(True))
    inf = float("inf")
    near = point_pairs(pts, pts, leaves, ix.dim, inf, ["label", "lw"], ["label", "lw"]).filter(
        F.col("p_label") < F.col("q_label")
    )
    pairs = F.col("p_lw") * F.col("q_lw")
    value = F.col("dist") * pairs if linkage == "average" else F.col("dist")
    out = near.groupBy(F.col("p_label").alias("ci"), F.col("q_label").alias("cj")).agg(
        fold(value).alias("d"), F.sum(pairs).alias("n")
    )
    return out.select("ci", "cj", (F.col("d") / F.col("n") if linkage == "average" else F.col("d")).alias("dist"))


def ward_increments(points: DataFrame) -> DataFrame:
    """``(ci, cj, increment)``: growth of the summed squared error when two clusters merge."""
    cfs = features_by(points, "label").select("label", "n", V.centre_of("ls", "n").alias("features"))
    return ward_pairs(cfs, dim_of(points))


def ward_pairs(cfs: DataFrame, dim: int) -> DataFrame:
    """The same from ``(label, n, features)`` with ``features`` the centroid."""
    ix = block_index(with_dim(cfs.select(F.col("label").cast("bigint").alias("id"), "features"), dim))
    per = ix.copies().join(cfs.select(F.col("label").cast("bigint").alias("id"), "n"), "id")
    pts = ix.points.drop("w").join(per, "pid")
    leaves, _ = walk_pairs(ix, ix, F.lit(True))
    near = point_pairs(pts, pts, leaves, dim, float("inf"), ["id", "n"], ["id", "n"]).filter(F.col("p_id") < F.col("q_id"))
    d2 = V.sqeuclidean("p_features", "q_features", dim)
    gain = F.col("p_n") * F.col("q_n") / (F.col("p_n") + F.col("q_n")) * d2
    return near.select(F.col("p_id").alias("ci"), F.col("q_id").alias("cj"), gain.alias("increment"))


def best_ward_pair(points: DataFrame) -> DataFrame:
    """``(ci, cj, increment, total_sse)`` of the cheapest merge."""
    best = ward_increments(points).agg(F.min(F.struct("increment", "ci", "cj")).alias("b"))
    base = total_sse(points).first()["total_sse"]
    return best.select("b.ci", "b.cj", "b.increment", (F.col("b.increment") + F.lit(base)).alias("total_sse"))


def cluster_summary(points: DataFrame) -> DataFrame:
    """``(label, n, low, high, centre, medoid)``; the medoid is the member nearest the centre."""
    dim = dim_of(points)
    base = points.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        V.per_dim(F.min, "features", dim).alias("low"),
        V.per_dim(F.max, "features", dim).alias("high"),
        V.per_dim(F.avg, "features", dim).alias("centre"),
    )
    rows = attach(points.select("id", "features", "label"), base, "label", "n")
    near = rows.groupBy("label").agg(F.min(F.struct(V.sqeuclidean("features", "centre", dim), "id")).alias("b"))
    return base.join(near, "label").select("label", "n", "low", "high", "centre", F.col("b.id").alias("medoid"))


def scattered_reps(points: DataFrame, c: int, alpha: float, rule: str = "sum") -> DataFrame:
    """``(label, rank, id, rep)``: up to ``c`` spread-out members per cluster, moved toward its centre.

    The first is farthest from the centre, each next one has the largest summed distance
    (``sum``) or largest least distance (``maxmin``) to those chosen. Each round is one
    pass that carries the chosen ones as a short array per cluster.
    """
    if rule not in ("sum", "maxmin"):
        raise ValueError("rule is 'sum' or 'maxmin'")
    dim = dim_of(points)
    pts = points.select("id", "features", "label")
    heads = cut(
        pts.groupBy("label").agg(
            F.count(F.lit(1)).alias("n"),
            V.per_dim(F.avg, "features", dim).alias("centre"),
            F.expr("cast(array() as array<struct<id: bigint, f: array<double>>>)").alias("chosen"),
        )
    )
    for i in range(c):
        rows = attach(pts, heads, "label", "n")
        free = rows.filter(~F.exists("chosen", lambda r: r["id"] == F.col("id")))
        if i == 0:
            score = V.euclidean("features", "centre", dim)
        else:
            gaps = F.transform("chosen", lambda r: V.euclidean(F.col("features"), r["f"], dim))
            score = F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b) if rule == "sum" else F.array_min(gaps)
        pick = free.groupBy("label").agg(
            F.max(F.struct(score.alias("s"), (-F.col("id")).alias("neg"), F.col("features").alias("f"))).alias("b")
        )
        item = F.array(F.struct((-F.col("b.neg")).alias("id"), F.col("b.f").alias("f")))
        grown = F.when(F.col("b").isNotNull(), F.concat("chosen", item)).otherwise(F.col("chosen"))
        heads = cut(heads.join(pick, "label", "left").select("label", "n", "centre", grown.alias("chosen")))
    return heads.select("label", "centre", F.posexplode("chosen").alias("pos", "r")).select(
        "label", (F.col("pos") + 1).alias("rank"), F.col("r.id").alias("id"), V.shrink("r.f", "centre", alpha).alias("rep")
    )


def rep_distance(reps: DataFrame, dim: int) -> DataFrame:
    """``(ci, cj, dist)``: least distance between representatives of two clusters.

    ``reps`` has ``label, rep``; the number of representatives per cluster is a constant.
    """
    from ..session import numbered

    rows, _, _ = numbered(reps.select("label", "rep"), F.col("label"), F.col("rep"), name="id")
    pts = with_dim(rows.select("id", F.col("rep").alias("features"), "label"), dim)
    return linkage_distance(pts, "single")
