"""Graph clustering: neighbour graph, parts, then merging of the best-scored pair.

Two versions. The first scores a pair by the edges that bisecting each side would cut; the
second only needs the edges inside and between clusters, so its statistics are aggregated
once and then added up as clusters merge.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bisection import bisection_stats, partition_graph
from ..operators.components import split_by_components
from ..operators.graphs import best_merge, bisection_scores, density_scores, edge_stats, pair_rows
from ..operators.neighbours import knn_graph
from ..session import cut
from ..sources.points import rebuild_labels

SCORES = "n_clusters int, score double"


def _guess(points: DataFrame) -> DataFrame:
    """A first guess for bisections: the coordinates, later weighted over the others."""
    x = F.col("features")
    return points.select("id", (x[0] + F.lit(1e-3) * F.aggregate(x, F.lit(0.0), lambda a, v: a + v)).alias("x"))


def _merged(stats: DataFrame, a: int, b: int) -> DataFrame:
    """Statistics after cluster ``b`` became part of ``a``: sums over the renamed pairs."""
    fix = lambda c: F.when(F.col(c) == b, F.lit(a)).otherwise(F.col(c))
    return (
        stats.select(F.least(fix("ci"), fix("cj")).alias("ci"), F.greatest(fix("ci"), fix("cj")).alias("cj"), "n_edges", "sum_weight")
        .groupBy("ci", "cj")
        .agg(F.sum("n_edges").alias("n_edges"), F.sum("sum_weight").alias("sum_weight"))
    )


def _inner(stats: DataFrame, names: DataFrame) -> DataFrame:
    own = stats.filter(F.col("ci") == F.col("cj")).select(F.col("ci").alias("label"), "n_edges", "sum_weight")
    return names.join(own, "label", "left").select(
        "label", F.coalesce("n_edges", F.lit(0)).alias("n"), F.coalesce("sum_weight", F.lit(0.0)).alias("c")
    )


def _rename(labels: DataFrame, moves: dict[int, int]) -> DataFrame:
    """Apply the driver's list of merges (one entry per initial part) to the labels."""
    if not moves:
        return labels
    table = labels.sparkSession.createDataFrame(list(moves.items()), "label int, into int")
    return labels.join(F.broadcast(table), "label", "left").select("id", F.coalesce("into", "label").alias("label"))


def _follow(moves: dict[int, int], a: int, b: int) -> None:
    for key, into in list(moves.items()):
        if into == b:
            moves[key] = a
    moves[b] = a


def chameleon2(
    points: DataFrame, k: int = 1, knn: int | None = None, m: int = 30, alpha: float = 2.0, beta: float = 1.0, m_fact: float = 1e3
):
    """``(labels, scores)``: labels from 1, and the score of every merge by clusters left.

    Mutual neighbour graph, ``m`` parts, parts broken into their components, then merges of
    the best positive score until ``k`` clusters are left.
    """
    if knn is None:
        knn = int(round(2 * math.log(points.count())))
    edges = cut(knn_graph(points, knn, mutual=True))
    vertices = cut(points.select("id"))
    parts = partition_graph(vertices, edges, m, cut(_guess(points)))
    labels = cut(split_by_components(parts, edges))
    stats = cut(edge_stats(edges, labels))
    count = labels.agg(F.countDistinct("label")).first()[0]
    moves: dict[int, int] = {}
    scores = []
    while count > k:
        names = stats.select(F.col("ci").alias("label")).unionByName(stats.select(F.col("cj").alias("label"))).distinct()
        best = best_merge(density_scores(pair_rows(stats.filter("ci <> cj"), _inner(stats, names)), alpha, beta, m_fact)).first()
        if best is None:
            break
        _follow(moves, best["ci"], best["cj"])
        stats = cut(_merged(stats, best["ci"], best["cj"]))
        count -= 1
        scores.append((count, float(best["score"])))
    out = rebuild_labels(_rename(labels, moves))
    return out, points.sparkSession.createDataFrame(scores, SCORES)


def chameleon(points: DataFrame, k: int = 1, knn: int = 10, m: int = 30, alpha: float = 2.0):
    """``(labels, scores)`` with the scores of the first version; a merge bisects only the new cluster."""
    edges = cut(knn_graph(points, knn))
    vertices = cut(points.select("id"))
    guess = cut(_guess(points))
    labels = partition_graph(vertices, edges, m, guess)
    stats = cut(edge_stats(edges, labels))
    halves = cut(bisection_stats(labels, edges, guess))
    count = halves.count()
    moves: dict[int, int] = {}
    scores = []
    while count > k:
        a = halves.select(F.col("label").alias("ci"), *[F.col(c).alias(n) for c, n in (("size", "s_i"), ("cut_n", "cut_n_i"), ("cut_w", "cut_w_i"))])
        b = halves.select(F.col("label").alias("cj"), *[F.col(c).alias(n) for c, n in (("size", "s_j"), ("cut_n", "cut_n_j"), ("cut_w", "cut_w_j"))])
        pairs = stats.filter("ci <> cj").select("ci", "cj", F.col("n_edges").alias("n_ij"), F.col("sum_weight").alias("w_ij"))
        best = best_merge(bisection_scores(pairs.join(a, "ci").join(b, "cj"), alpha)).first()
        if best is None:
            break
        _follow(moves, best["ci"], best["cj"])
        stats = cut(_merged(stats, best["ci"], best["cj"]))
        count -= 1
        scores.append((count, float(best["score"])))
        if count > k:
            new = _rename(labels, moves).filter(F.col("label") == best["ci"])
            fresh = bisection_stats(cut(new), edges, guess)
            halves = cut(halves.filter(~F.col("label").isin(best["ci"], best["cj"])).unionByName(fresh))
    out = rebuild_labels(_rename(labels, moves))
    return out, points.sparkSession.createDataFrame(scores, SCORES)
