"""Density clusters: core rows within a radius of one another, borders, noise.

Blocks that lie wholly within the radius of each other are joined as blocks; their
points are never paired. Points are paired only across block pairs that straddle the
radius, and after blocks known to be in one cluster have been taken out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import FANOUT_BITS, BlockIndex, inside, n_blocks, point_pairs, walk_pairs, with_points, within
from ..operators.components import connected_components
from ..operators.neighbours import index_of, location_counts
from ..session import attach, cut, numbered

LEVELS = 64  # room for the level inside a node's vertex number
PRUNE_AT = 20_000_000  # straddling point pairs worth one more component run


def _vertex(node, level: int):
    return -(node * LEVELS + level + 1)


def core_components(ix: BlockIndex, core: DataFrame, eps: float) -> DataFrame:
    """``(pid, component)`` of core locations; ``core`` has ``pid, is_core``."""
    flagged = cut(ix.points.join(core.select("pid", F.col("is_core").cast("int").alias("is_core")), "pid"))
    cx = with_points(ix, flagged, {"cores": ("sum", F.col("is_core"))})
    has = (F.col("a_cores") > 0) & (F.col("b_cores") > 0)
    leaves, settled = walk_pairs(cx, cx, within(eps) & has, inside(eps))
    settled = cut(settled.select("level", "a_node", "b_node"))

    # nodes whose cores are known to be one cluster, and the edges between such nodes
    edges, above = None, None
    for level in range(len(cx.nodes) - 1, -1, -1):
        pairs = settled.filter(F.col("level") == level)
        own = pairs.select(F.col("a_node").alias("node"))
        link = pairs.filter(F.col("a_node") < F.col("b_node")).select(
            _vertex(F.col("a_node"), level).alias("src"), _vertex(F.col("b_node"), level).alias("dst")
        )
        if above is not None:
            nodes = cx.nodes[level].filter(F.col("cores") > 0).select("node", F.shiftright("node", FANOUT_BITS).alias("up"))
            handed = nodes.join(above.withColumnRenamed("node", "up"), "up")
            link = link.unionByName(
                handed.select(_vertex(F.col("node"), level).alias("src"), _vertex(F.col("up"), level + 1).alias("dst"))
            )
            own = own.unionByName(handed.select("node"))
        above = own.distinct()
        edges = link if edges is None else edges.unionByName(link)
    together = cut(above.select("node", F.lit(True).alias("joined")))
    edges = cut(edges)

    cores = flagged.filter(F.col("is_core") == 1)
    vertex = F.when(F.col("joined"), _vertex(F.col("block"), 0)).otherwise(F.col("rank"))
    named = cut(
        cores.join(together.withColumnRenamed("node", "block"), "block", "left").select(
            "pid", "features", "block", vertex.alias("vertex")
        )
    )

    open_pairs = leaves.filter(F.col("a_node") <= F.col("b_node"))
    marks_a = together.select(F.col("node").alias("a_node"), F.col("joined").alias("a_joined"))
    marks_b = together.select(F.col("node").alias("b_node"), F.col("joined").alias("b_joined"))
    open_pairs = cut(open_pairs.join(marks_a, "a_node", "left").join(marks_b, "b_node", "left"))
    both = F.coalesce("a_joined", F.lit(False)) & F.coalesce("b_joined", F.lit(False))
    load = open_pairs.filter(both).agg(F.sum(F.col("a_cores") * F.col("b_cores"))).first()[0] or 0
    if load > PRUNE_AT:
        blocks = together.select(_vertex(F.col("node"), 0).alias("id"))
        known = cut(connected_components(blocks, edges))
        ca = known.select(F.col("id").alias("__va"), F.col("component").alias("__ca"))
        cb = known.select(F.col("id").alias("__vb"), F.col("component").alias("__cb"))
        open_pairs = (
            open_pairs.withColumn("__both", both)
            .join(ca, _vertex(F.col("a_node"), 0) == F.col("__va"), "left")
            .join(cb, _vertex(F.col("b_node"), 0) == F.col("__vb"), "left")
            .filter(~(F.col("__both") & (F.col("__ca") == F.col("__cb"))))
        )
    near = point_pairs(named, named, open_pairs, ix.dim, eps, ["vertex"], ["vertex"])
    found = (
        near.filter(F.col("p_vertex") != F.col("q_vertex"))
        .select(F.least("p_vertex", "q_vertex").alias("src"), F.greatest("p_vertex", "q_vertex").alias("dst"))
        .distinct()
    )
    vertices = named.select(F.col("vertex").alias("id")).distinct()
    comps = connected_components(vertices, edges.unionByName(found))
    return named.join(comps, F.col("vertex") == F.col("id")).select("pid", "component", "features", "block")


def location_labels(ix: BlockIndex, eps: float, min_pts: int) -> DataFrame:
    """``(pid, label, is_core)`` for locations."""
    counts = location_counts(ix, eps, enough=min_pts)
    core = cut(counts.select("pid", (F.col("n_neigh") >= min_pts).alias("is_core")))
    comps = cut(core_components(ix, core, eps))
    heads = comps.groupBy("component").agg(F.min("pid").alias("head"), F.count(F.lit(1)).alias("places"))
    order, _, _ = numbered(heads, F.col("head"), name="label")
    named = order.select("component", F.col("label").cast("int").alias("label"), "places")
    inner = cut(attach(comps, named, "component", "places", by="pid").select("pid", "label", "features", "block"))

    # borders: the lowest label among the cores within reach
    rest = cut(ix.points.join(core.filter(~F.col("is_core")).select("pid"), "pid").withColumn("edge", F.lit(1)))
    if rest.isEmpty() or inner.isEmpty():
        border = rest.select("pid", F.lit(-1).alias("label"))
    else:
        flags = ix.points.select("pid", "features", "w", "rank", "block").join(
            core.select("pid", F.col("is_core").cast("int").alias("core")), "pid"
        )
        bx = with_points(ix, flags, {"cores": ("sum", F.col("core")), "edges": ("sum", 1 - F.col("core"))})
        wanted = (F.col("a_edges") > 0) & (F.col("b_cores") > 0)
        leaves, _ = walk_pairs(bx, bx, within(eps) & wanted)
        near = point_pairs(rest, inner, leaves, ix.dim, eps, ["pid"], ["label"])
        low = near.groupBy(F.col("p_pid").alias("pid")).agg(F.min("q_label").alias("label"))
        border = rest.select("pid").join(low, "pid", "left").select("pid", F.coalesce("label", F.lit(-1)).alias("label"))
    return inner.select("pid", "label", F.lit(True).alias("is_core")).unionByName(
        border.select("pid", F.col("label").cast("int").alias("label"), F.lit(False).alias("is_core"))
    )


def dbscan(points: DataFrame | BlockIndex, eps: float, min_pts: int) -> DataFrame:
    """``(id, label, is_core)``: clusters from 0 by smallest core row, -1 for noise.

    A core row has at least ``min_pts`` rows within ``eps``, itself counted; a border row
    takes the lowest label among the core rows it can reach.
    """
    ix = index_of(points)
    return ix.spread(location_labels(ix, eps, min_pts)).select("id", "label", "is_core")
