"""Statistics of a clustered graph and the scores for merging two of its clusters.

Edges are ``(src, dst, weight)`` with each undirected edge once; labels are ``(id, label)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the labels of both ends, smaller label first: ``(src, dst, weight, ci, cj)``."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("__a"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("__b"))
    # one row per vertex: too much to send through the driver in every round
    return edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select(
        "src", "dst", "weight", F.least("__a", "__b").alias("ci"), F.greatest("__a", "__b").alias("cj")
    )


def edge_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(ci, cj, n_edges, sum_weight)`` inside (ci = cj) and between clusters, in one aggregate."""
    return label_edges(edges, labels).groupBy("ci", "cj").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("sum_weight")
    )


def inner_stats(stats: DataFrame) -> DataFrame:
    """``(label, n_edges, closeness, mean_closeness)`` from the rows with ci = cj."""
    return stats.filter(F.col("ci") == F.col("cj")).select(
        F.col("ci").alias("label"),
        "n_edges",
        F.col("sum_weight").alias("closeness"),
        (F.col("sum_weight") / F.col("n_edges")).alias("mean_closeness"),
    )


def connecting_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between two clusters."""
    return label_edges(edges, labels).filter(F.col("ci") != F.col("cj"))


def adjacency(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed neighbour rows ``(id, neighbour)`` with NULL for isolated vertices.

    Rows instead of one list per vertex, so that a hub does not become one large value.
    """
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).unionByName(
        edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"))
    )
    return vertices.select("id").join(both.distinct(), "id", "left")


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("id"), "weight").unionByName(edges.select(F.col("dst").alias("id"), "weight"))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def laplacian(edges: DataFrame, normalised: bool = False) -> DataFrame:
    """Long form ``(i, j, v)`` of D - W, or of I - D^-1/2 W D^-1/2."""
    deg = degrees(edges)
    both = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight").unionByName(
        edges.select(F.col("dst").alias("i"), F.col("src").alias("j"), "weight")
    )
    if not normalised:
        diag = deg.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("strength").alias("v"))
        return diag.unionByName(both.select("i", "j", (-F.col("weight")).alias("v")))
    di = deg.select(F.col("id").alias("i"), F.col("strength").alias("__di"))
    dj = deg.select(F.col("id").alias("j"), F.col("strength").alias("__dj"))
    off = both.join(di, "i").join(dj, "j").select(
        "i", "j", (-F.col("weight") / F.sqrt(F.col("__di") * F.col("__dj"))).alias("v")
    )
    return deg.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")).unionByName(off)


def _joined(x: Column, y: Column) -> Column:
    """A product, or the sum when one factor is 0."""
    return F.when((x != 0) & (y != 0), x * y).otherwise(x + y)


def pair_table(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Cluster pairs that share an edge, with the inner statistics of both sides."""
    inner = labels.select("label").distinct().join(inner_stats(stats), "label", "left").select(
        "label", F.coalesce("n_edges", F.lit(0)).alias("n"), F.coalesce("closeness", F.lit(0.0)).alias("c")
    )
    return pair_rows(stats.filter(F.col("ci") != F.col("cj")), inner)


def pair_rows(between: DataFrame, inner: DataFrame) -> DataFrame:
    a = inner.select(F.col("label").alias("ci"), F.col("n").alias("n_i"), F.col("c").alias("c_i"))
    b = inner.select(F.col("label").alias("cj"), F.col("n").alias("n_j"), F.col("c").alias("c_j"))
    return between.select("ci", "cj", F.col("n_edges").alias("n_ij"), F.col("sum_weight").alias("w_ij")).join(a, "ci").join(b, "cj")


def density_scores(pairs: DataFrame, alpha: float = 2.0, beta: float = 1.0, m_fact: float = 1e3) -> DataFrame:
    """Scores from inner edges alone: adds ``rho, rel_closeness, rel_interconnectivity, score``."""
    n_i, n_j, c_i, c_j = (F.col(c) for c in ("n_i", "n_j", "c_i", "c_j"))
    edgeless = (n_i == 0) | (n_j == 0)
    d_i, d_j = c_i / n_i, c_j / n_j
    rho = F.when(~edgeless, F.least(d_i, d_j) / F.greatest(d_i, d_j))
    ratio = F.col("w_ij") / F.col("n_ij") / (c_i + c_j)
    closeness = F.when(edgeless, F.lit(float(m_fact)) * ratio).otherwise((n_i + n_j) * ratio)
    linked = F.when(edgeless, F.lit(1.0)).otherwise(F.col("n_ij") / F.least(n_i, n_j) * F.pow(rho, F.lit(float(beta))))
    # two single rows have no inner weight at all: their closeness is unbounded
    closeness = F.when(c_i + c_j == 0, F.lit(float("inf"))).otherwise(closeness)
    return (
        pairs.withColumn("rho", rho)
        .withColumn("rel_closeness", closeness)
        .withColumn("rel_interconnectivity", linked)
        .withColumn("score", _joined(F.col("rel_interconnectivity"), F.pow("rel_closeness", F.lit(float(alpha)))))
    )


def bisection_scores(pairs: DataFrame, alpha: float = 2.0) -> DataFrame:
    """Scores from the bisection of each side.

    Needs ``n_ij, w_ij``, sizes ``s_i, s_j`` and the cut edges of both bisections
    ``cut_n_*, cut_w_*``. Adds ``rel_interconnectivity, rel_closeness, score``.
    """
    cut_w = F.col("cut_w_i") + F.col("cut_w_j")
    linked = F.when(cut_w != 0, F.col("w_ij") / (cut_w / 2.0)).otherwise(F.lit(float("inf")))
    whole = F.col("s_i") + F.col("s_j")
    mean_i, mean_j = F.col("cut_w_i") / F.col("cut_n_i"), F.col("cut_w_j") / F.col("cut_n_j")
    inner = F.col("s_i") / whole * mean_i + F.col("s_j") / whole * mean_j
    closeness = F.when((F.col("cut_n_i") > 0) & (F.col("cut_n_j") > 0), F.col("w_ij") / F.col("n_ij") / inner)
    return (
        pairs.withColumn("rel_interconnectivity", linked)
        .withColumn("rel_closeness", closeness)
        .withColumn("score", _joined(F.col("rel_interconnectivity"), F.pow("rel_closeness", F.lit(float(alpha)))))
    )


def best_merge(scored: DataFrame) -> DataFrame:
    """The pair with the highest positive score, ties to the smallest pair: ``(ci, cj, score)``."""
    ok = scored.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") > 0))
    top = ok.agg(F.max(F.struct("score", (-F.col("ci")).alias("a"), (-F.col("cj")).alias("b"))).alias("t"))
    return top.filter(F.col("t").isNotNull()).select(
        (-F.col("t.a")).alias("ci"), (-F.col("t.b")).alias("cj"), F.col("t.score").alias("score")
    )
