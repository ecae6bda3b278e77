"""Nearest centres and the costs of an assignment."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.points import dim_of, with_dim
from .blocks import FANOUT_BITS, SLACK, _side, block_index, point_pairs, spread_over
from .neighbours import PairsWithin

MAX_VALUES = 50_000  # centre coordinates that may travel inside the plan
FEW = 32  # centres that are compared by generated code; more are compared as arrays
TABLE = 1 << 20  # distances that a task holds at a time


def _literal_centres(rows, dim: int) -> Column:
    """Checked-small centres as one constant array of structs."""
    text = json.dumps([{"c": int(r["center"]), "f": [float(v) for v in r["features"]]} for r in rows])
    return F.from_json(F.lit(text), "array<struct<c: bigint, f: array<double>>>")


def _nearest_centres(rows, dim: int, square: bool, k: int):
    """The ``k`` nearest of checked-small centres for rows ``(id, features)``, as ``id, rank, center, dist``; made here to travel by value."""
    rows = sorted((int(r["center"]), [float(v) for v in r["features"]]) for r in rows)
    ids = np.array([c for c, _ in rows])
    centres = np.array([f for _, f in rows])
    k = min(k, len(ids))

    def run(batches):
        step = max(TABLE // len(ids), 1)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = batch.column("features").flatten().to_numpy().reshape(-1, dim)
                d = np.zeros((len(x), len(ids)))
                for i in range(dim):
                    d += np.square(x[:, None, i] - centres[None, :, i])
                d = d if square else np.sqrt(d)
                # centres stand in order of their ids, so the first of equals is the smallest
                best = d.argmin(axis=1)[:, None] if k == 1 else d.argsort(axis=1, kind="stable")[:, :k]
                owner = np.repeat(np.arange(len(x)), k)
                ranks = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
                dist = np.take_along_axis(d, best, axis=1).ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(owner)), pa.array(ranks), pa.array(ids[best.ravel()]), pa.array(dist)], ["id", "rank", "center", "dist"]
                )

    return run


def assign_nearest(
    points: DataFrame, centers: DataFrame, metric: str | object = "euclidean", k: int = 1, max_values: int = MAX_VALUES
) -> DataFrame:
    """``(id, rank, center, dist)``: the ``k`` nearest centres of each row, ties to the smaller.

    ``centers`` has ``center, features``. Up to ``max_values`` coordinates they travel as a
    constant and each row is settled where it is, with no shuffle. Beyond that the points
    and the centres are both cut into blocks and met through the box trees.
    """
    dim = dim_of(points)
    limit = max(max_values // dim, 1)
    rows = centers.select("center", "features").limit(limit + 1).collect()
    if not rows:
        raise ValueError("no centres given")
    if len(rows) > limit:
        return _assign_by_blocks(points, centers, metric, k, dim)
    if len(rows) > FEW and metric in ("euclidean", "sqeuclidean"):
        kind = points.schema["id"].dataType.simpleString()
        found = _nearest_centres(rows, dim, metric == "sqeuclidean", k)
        return points.select("id", "features").mapInArrow(found, f"id {kind}, rank int, center bigint, dist double")
    dist = V.metric(metric, dim)
    ranked = F.transform(
        _literal_centres(rows, dim), lambda c: F.struct(dist(F.col("features"), c["f"]).alias("d"), c["c"].alias("c"))
    )
    if k == 1:
        best = F.array_min(ranked)
        return points.select("id", best.alias("b")).select(
            "id", F.lit(1).alias("rank"), F.col("b.c").alias("center"), F.col("b.d").alias("dist")
        )
    best = F.slice(F.array_sort(ranked), 1, k)
    return points.select("id", F.posexplode(best).alias("pos", "b")).select(
        "id", (F.col("pos") + 1).alias("rank"), F.col("b.c").alias("center"), F.col("b.d").alias("dist")
    )


def _assign_by_blocks(points: DataFrame, centers: DataFrame, metric, k: int, dim: int) -> DataFrame:
    """The same for any number of centres: node pairs are dropped when a closer node is sure."""
    if callable(metric):
        raise ValueError("own metrics need a centre table that fits max_values")
    V.metric(metric)
    wide = math.sqrt(dim) if metric in ("manhattan", "chebyshev") else 1.0
    left, right = points, centers.select(F.col("center").alias("id"), "features")
    if metric == "cosine":
        unit = lambda df: with_dim(
            df.withColumn("features", V.scale("features", F.lit(1.0) / F.sqrt(V.dot("features", "features", dim)))), dim
        )
        left, right = unit(left), unit(right)
    a_ix, b_ix = block_index(left), block_index(with_dim(right, dim), max(32, k))
    la, lb = len(a_ix.nodes) - 1, len(b_ix.nodes) - 1
    pairs = _side(a_ix.nodes[la], "a").join(_side(b_ix.nodes[lb], "b"), F.col("a_node") == F.col("b_node"))

    def prune(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("gap2", V.box_gap2("a_lo", "a_hi", "b_lo", "b_hi", dim)).withColumn(
            "span2", V.box_span2("a_lo", "a_hi", "b_lo", "b_hi", dim)
        )
        sure = F.min(F.when(F.col("b_n") >= k, F.col("span2"))).over(W.partitionBy("a_node"))
        return frame.withColumn("bound2", sure * F.lit(wide * wide * (1.0 + SLACK))).filter(
            F.col("bound2").isNull() | (F.col("gap2") <= F.col("bound2"))
        )

    pairs = prune(pairs.withColumn("b_n", F.col("b_w")))
    while la > 0 or lb > 0:
        if la > 0:
            la -= 1
            down = _side(a_ix.nodes[la], "a")
            up = pairs.select(F.col("a_node").alias("__up"), *[c for c in pairs.columns if c.startswith("b_") and c != "b_n"])
            pairs = up.join(down, F.shiftright("a_node", FANOUT_BITS) == F.col("__up")).drop("__up")
        if lb > 0:
            lb -= 1
            down = _side(b_ix.nodes[lb], "b")
            up = pairs.select(F.col("b_node").alias("__up"), *[c for c in pairs.columns if c.startswith("a_")])
            pairs = up.join(down, F.shiftright("b_node", FANOUT_BITS) == F.col("__up")).drop("__up")
        pairs = prune(pairs.withColumn("b_n", F.col("b_w")))
    leaves = spread_over(pairs.select("a_node", "b_node", "b_lo", "b_hi", "bound2"), "a_node")
    d = V.metric(metric, dim)
    p = a_ix.points.select(F.col("block").alias("a_node"), "pid", F.col("features").alias("pf"))
    q = b_ix.points.select(F.col("block").alias("b_node"), F.col("pid").alias("center"), F.col("features").alias("qf"))
    order = W.partitionBy("pid").orderBy("dist", "center")
    near = (
        spread_over(p.join(leaves, "a_node").drop("b_lo", "b_hi", "bound2", "a_node"), "b_node")
        .join(q, "b_node")
        .select("pid", "center", d(F.col("pf"), F.col("qf")).alias("dist"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )
    if b_ix.has_copies and k > 1:
        raise ValueError("centres must be distinct for k > 1")
    if not a_ix.has_copies:
        return near.select(F.col("pid").alias("id"), "rank", "center", "dist")
    lists = near.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("rank", "center", "dist"))).alias("l"))
    return a_ix.spread(lists).select("id", F.explode("l").alias("s")).select("id", "s.rank", "s.center", "s.dist")


def total_cost(assigned: DataFrame) -> DataFrame:
    """``(total_cost, n_points, n_medoids, cost_per_medoid, cost_per_point)``."""
    return assigned.agg(
        F.sum("dist").alias("total_cost"),
        F.count(F.lit(1)).alias("n_points"),
        F.countDistinct("center").alias("n_medoids"),
    ).select(
        "total_cost",
        "n_points",
        "n_medoids",
        (F.col("total_cost") / F.col("n_medoids")).alias("cost_per_medoid"),
        (F.col("total_cost") / F.col("n_points")).alias("cost_per_point"),
    )


def cluster_costs(assigned: DataFrame) -> DataFrame:
    """``(center, n, mean_dist)`` of each cluster."""
    return assigned.groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("mean_dist"))


def summed_mean_cost(assigned: DataFrame) -> DataFrame:
    """The sum over clusters of their mean distance: one row ``(objective)``."""
    return cluster_costs(assigned).agg(F.sum("mean_dist").alias("objective"))


def best_run(costs: DataFrame) -> DataFrame:
    """The run with the lowest cost, the first one on ties: ``(run, cost)``."""
    return costs.agg(F.min(F.struct("cost", "run")).alias("b")).select("b.run", "b.cost")


def closest_pair(pairs: DataFrame | PairsWithin) -> DataFrame:
    """The row ``(src, dst, dist)`` with the least distance, ties to the smaller ids."""
    if isinstance(pairs, PairsWithin):
        near = pairs.nearest()
        if near is None:
            return closest_pair(pairs.listed())
        # the smallest id in a pair at the least distance has its smallest partner there as its nearest
        pairs = near.select(F.least("id", "nearest").alias("src"), F.greatest("id", "nearest").alias("dst"), "dist")
    return pairs.agg(F.min(F.struct("dist", "src", "dst")).alias("b")).select("b.src", "b.dst", "b.dist")


def nearest_other(pairs: DataFrame | PairsWithin) -> DataFrame:
    """For each end of ``(src, dst, dist)`` its nearest partner: ``(id, nearest, dist)``."""
    if isinstance(pairs, PairsWithin):
        near = pairs.nearest()
        return nearest_other(pairs.listed()) if near is None else near
    end = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("nearest"))
    ends = F.explode(F.array(end("src", "dst"), end("dst", "src")))
    both = pairs.select(ends.alias("e"), "dist").select("e.id", "e.nearest", "dist")
    return both.groupBy("id").agg(F.min(F.struct("dist", "nearest")).alias("b")).select("id", "b.nearest", "b.dist")
