"""Density hierarchies: reachability, flat extraction, profiles, and stable clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.blocks import BlockIndex, point_pairs, walk_pairs, with_points, within
from ..operators.components import compress, connected_components, in_one_task
from ..operators.forest import merge_table, reach_forest
from ..operators.neighbours import knn_index, location_core_distance, location_knn
from ..session import attach, cut, numbered

LIST_LENGTH = 8  # neighbours kept per location to start the forest from


class Hierarchy:
    """The tables of a density hierarchy over locations.

    ``points``: pid, core_dist, attach_dist, attach_to. ``forest``: src, dst, w.
    """

    def __init__(self, ix: BlockIndex, eps: float | None, points: DataFrame, forest: DataFrame):
        self.ix, self.eps, self.points, self.forest = ix, eps, points, forest


def _attach_level(ix: BlockIndex, core: DataFrame, knn: DataFrame, eps: float | None) -> DataFrame:
    """For each location the core ``o`` with the least max(core(o), distance): ``(pid, attach_dist, attach_to)``."""
    cores = core.filter(F.col("core_dist").isNotNull())
    seen = knn.join(cores.select(F.col("pid").alias("nbr"), F.col("core_dist").alias("co")), "nbr")
    top = seen.groupBy("pid").agg(F.min(F.greatest("co", "dist")).alias("radius"))
    cap = F.lit(float("inf") if eps is None else float(eps))
    pts = cut(
        ix.points.join(core, "pid").join(top, "pid", "left").withColumn("radius", F.least(F.coalesce("radius", cap), cap))
    )
    dense = pts.withColumn("has", F.col("core_dist").isNotNull().cast("int"))
    tree = with_points(ix, dense, {"radius": ("max", F.col("radius")), "has": ("max", F.col("has")), "low": ("min", F.col("core_dist"))})
    keep = within(F.col("a_radius")) & (F.col("b_has") > 0) & (F.col("b_low") <= F.col("a_radius"))
    leaves, _ = walk_pairs(tree, tree, keep)
    near = point_pairs(pts, dense.filter(F.col("has") > 0), leaves, ix.dim, F.col("p_radius"), ["pid", "radius"], ["pid", "core_dist"])
    level = F.greatest("dist", "q_core_dist")
    best = (
        near.filter(F.col("p_pid") != F.col("q_pid"))
        .filter(level <= F.col("p_radius"))
        .groupBy(F.col("p_pid").alias("pid"))
        .agg(F.min(F.struct(level.alias("d"), F.col("q_pid").alias("o"))).alias("b"))
    )
    return best.select("pid", F.col("b.d").alias("attach_dist"), F.col("b.o").alias("attach_to"))


def density_hierarchy(points: DataFrame | BlockIndex, min_pts: int, eps: float | None = None) -> Hierarchy:
    """Core distances, the spanning forest of the cores under mutual reachability, and where
    every other row attaches. ``eps`` caps all distances."""
    ix = knn_index(points, max(min_pts - 1, LIST_LENGTH))
    core = cut(location_core_distance(ix, min_pts, eps))
    knn = cut(location_knn(ix, max(min_pts - 1, LIST_LENGTH)))
    forest = cut(reach_forest(ix, core, knn, eps))
    level = _attach_level(ix, core, knn, eps)
    return Hierarchy(ix, eps, cut(core.join(level, "pid", "left")), forest)


def _whole_forest(h: Hierarchy) -> tuple[DataFrame, DataFrame]:
    """Vertices with weights and the forest with the non-core rows attached."""
    loose = h.points.filter(F.col("core_dist").isNull() & F.col("attach_to").isNotNull())
    extra = loose.select(F.col("attach_to").alias("src"), F.col("pid").alias("dst"), F.col("attach_dist").alias("w"))
    return h.ix.points.select(F.col("pid").alias("id"), "w"), h.forest.unionByName(extra)


def reachability(h: Hierarchy) -> DataFrame:
    """``(id, core_dist, reach_dist)``; NULL stands for infinity.

    A merge of two parts is charged to the smallest id of the part that does not hold the
    smaller id, so every row but the first of its piece carries exactly one merge. Copies
    follow their location at the location's core distance.
    """
    verts, forest = _whole_forest(h)
    merges = merge_table(verts, forest)
    reach = merges.select(F.col("right").alias("pid"), F.col("height").alias("reach_dist"))
    per = h.points.select("pid", "core_dist").join(reach, "pid", "left")
    rows = h.ix.spread(per.withColumn("first", F.col("pid")))
    copy = F.col("id") != F.col("first")
    return rows.select("id", "core_dist", F.when(copy, F.col("core_dist")).otherwise(F.col("reach_dist")).alias("reach_dist"))


def extract_clusters(h: Hierarchy, eps: float) -> DataFrame:
    """``(id, label)`` at ``eps``, which must not exceed the cap of the hierarchy; -1 is noise."""
    if h.eps is not None and eps > h.eps:
        raise ValueError("the hierarchy was capped at a smaller distance")
    limit = F.lit(float(eps))
    cores = h.points.filter(F.col("core_dist") <= limit).select(F.col("pid").alias("id"))
    comps = cut(connected_components(cores, h.forest.filter(F.col("w") <= limit)))
    heads = comps.groupBy("component").agg(F.count(F.lit(1)).alias("places"))
    named, _, _ = numbered(heads, F.col("component"), name="label")
    inner = attach(comps, named, "component", "places", by="id")
    inner = cut(inner.select(F.col("id").alias("pid"), F.col("label").cast("int").alias("label")))
    rest = h.points.join(inner.select("pid"), "pid", "left_anti")
    reach = inner.select(F.col("pid").alias("attach_to"), "label")
    near = rest.join(reach, "attach_to", "left").select(
        "pid", F.when(F.col("attach_dist") <= limit, F.col("label")).alias("label")
    )
    both = inner.unionByName(near.select("pid", F.coalesce("label", F.lit(-1)).alias("label")))
    return h.ix.spread(both).select("id", "label")


def reachability_profile(h: Hierarchy, ladder: list[float], cap: float | None = None) -> DataFrame:
    """``(id, bar, order_key)``: bar heights in an order that keeps sub-clusters together.

    ``order_key`` holds the smallest id of the row's part at each threshold of the ladder,
    from high to low, then the row's location. Infinite bars are drawn at 1.15 times the cap.
    """
    verts, forest = _whole_forest(h)
    verts = verts.select("id")
    top = cap if cap is not None else (h.eps if h.eps is not None else max(ladder))
    keys = verts
    names = []
    for i, t in enumerate(sorted(ladder, reverse=True)):
        comps = connected_components(verts, forest.filter(F.col("w") <= F.lit(float(t))))
        keys = keys.join(comps.withColumnRenamed("component", f"k{i}"), "id")
        names.append(f"k{i}")
    key = keys.select(F.col("id").alias("pid"), F.array(*names, F.col("id")).alias("order_key"))
    rows = reachability(h)
    located = h.ix.spread(key)
    bar = F.coalesce(F.col("reach_dist"), F.lit(1.15 * top))
    return rows.join(located, "id").select("id", bar.alias("bar"), "order_key")


def stable_clusters(points: DataFrame | BlockIndex, min_cluster_size: int = 5, min_samples: int | None = None):
    """Clusters of varying density: ``(labels, tree)``.

    ``labels`` is ``(id, label, probability, outlier_score)``; ``tree`` is the condensed tree
    ``(cluster, parent, size, birth, death, stability, chosen)``. Density is
    1 / mutual-reachability distance; a split counts only when both sides keep
    ``min_cluster_size`` rows; the set of clusters with the largest summed stability is
    chosen bottom-up, one condensed level per round.
    """
    samples = min_samples if min_samples is not None else min_cluster_size
    ix = knn_index(points, max(samples, LIST_LENGTH))
    core = cut(location_core_distance(ix, samples + 1))
    knn = cut(location_knn(ix, max(samples, LIST_LENGTH)))
    forest = cut(reach_forest(ix, core, knn))
    verts = ix.points.select(F.col("pid").alias("id"), "w")
    merges = cut(merge_table(verts, forest))
    size_of = merges.select("step", "size")
    small = int(min_cluster_size)
    density = lambda h: F.lit(1.0) / F.greatest(h, F.lit(1e-12))

    # sizes of both sides of every merge
    weights = verts.select("id", F.col("w").alias("size"))

    def side(name: str) -> DataFrame:
        made = merges.filter(F.col(f"{name}_step") > 0).select("step", F.col(f"{name}_step").alias("child"))
        made = made.join(size_of.withColumnRenamed("step", "child"), "child").select("step", "child", "size")
        row = merges.filter(F.col(f"{name}_step") == 0).select("step", F.col(name).alias("id"))
        row = row.join(weights, "id").select("step", (-F.col("id") - 1).alias("child"), "size")
        return made.unionByName(row)

    kids = cut(side("left").unionByName(side("right")).withColumnRenamed("step", "up"))
    splits = kids.filter(F.col("size") >= small).groupBy("up").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 2)
    tops = kids.filter(F.col("size") >= small).join(splits.select("up"), "up").select("child", "up")
    # heavy nodes (and heavy single locations) follow parents up to the top of their condensed cluster
    heavy = kids.filter(F.col("size") >= small).join(tops.select("child", F.lit(True).alias("top")), "child", "left")
    hooks = heavy.select(F.col("child").alias("id"), F.when(F.col("top"), F.col("child")).otherwise(F.col("up")).alias("parent"))
    has_parent = kids.select(F.col("child").alias("step"))
    root_nodes = merges.join(has_parent, "step", "left_anti").select(F.col("step").alias("id"), F.col("step").alias("parent"))
    cluster_of = compress(hooks.unionByName(root_nodes))
    # light nodes and rows follow parents up to the first heavy node
    light = kids.filter(F.col("size") < small).select(F.col("child").alias("id"), F.col("up").alias("parent"))
    stops = cluster_of.select("id", F.col("id").alias("parent"))
    fall = compress(light.unionByName(stops))
    heights = merges.select(F.col("step").alias("node"), "height")
    rows = (
        verts.select((-F.col("id") - 1).alias("id"), F.col("id").alias("pid"), "w")
        .join(fall, "id")
        .join(cluster_of.select(F.col("id").alias("root"), F.col("root").alias("cluster")), "root")
        .join(heights.withColumnRenamed("node", "root"), "root", "left")
        .join(core, "pid")
        .select("pid", "w", "cluster", density(F.coalesce("height", "core_dist")).alias("lam"))
    )
    rows = cut(rows)
    birth = tops.join(heights.withColumnRenamed("node", "up"), "up").join(
        cluster_of.select(F.col("id").alias("up"), F.col("root").alias("parent")), "up"
    )
    roots = root_nodes.select(F.col("id").alias("cluster"), F.lit(None).cast("bigint").alias("parent"), F.lit(0.0).alias("birth"))
    nodes = cut(birth.select(F.col("child").alias("cluster"), "parent", density(F.col("height")).alias("birth")).unionByName(roots))
    own = rows.groupBy("cluster").agg(
        F.sum("w").alias("own"), F.sum(F.col("w") * F.col("lam")).alias("own_lam"), F.max("lam").alias("own_max")
    )
    child_sizes = kids.select(F.col("child").alias("cluster"), "size").unionByName(
        root_nodes.join(merges.select(F.col("step").alias("id"), "size"), "id").select(F.col("id").alias("cluster"), "size")
    )
    tree = cut(nodes.join(child_sizes, "cluster").join(own, "cluster", "left"))
    passed = tree.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("cluster")).agg(
        F.sum(F.col("size") * F.col("birth")).alias("kids_lam"), F.max("birth").alias("kids_max")
    )
    zero = F.lit(0.0)
    tree = cut(
        tree.join(passed, "cluster", "left").select(
            "cluster",
            "parent",
            "size",
            "birth",
            F.greatest(F.coalesce("own_max", zero), F.coalesce("kids_max", zero)).alias("death"),
            (
                F.coalesce("own_lam", zero) + F.coalesce("kids_lam", zero) - F.col("size") * F.col("birth")
            ).alias("stability"),
        )
    )
    return _stable_labels(ix, tree, *_picked(tree), rows)


def _fold_tree(cluster: np.ndarray, parent: np.ndarray, stability: np.ndarray, death: np.ndarray):
    """Per cluster its highest chosen ancestor (itself included), whether there is one, and the largest density below it.

    A root is its own parent.
    """
    ids, at = np.unique(cluster, return_index=True)
    up = np.minimum(np.searchsorted(ids, parent[at]), len(ids) - 1)
    up = np.where((ids[up] == parent[at]) & (parent[at] != ids), up, -1).tolist()
    rooted = (parent[at] == ids).tolist()
    stability, deep = stability[at].tolist(), death[at].tolist()
    kids, waiting = [0.0] * len(ids), [0] * len(ids)
    for p in up:
        if p >= 0:
            waiting[p] += 1
    inner = [n > 0 for n in waiting]
    order = [c for c, n in enumerate(waiting) if not n]
    chosen = [False] * len(ids)
    for c in order:  # leaves first; grows while it is read
        # the root of a tree is never a cluster of its own when it splits
        chosen[c] = not inner[c] or (stability[c] >= kids[c] and not rooted[c])
        p = up[c]
        if p >= 0:
            kids[p] += stability[c] if chosen[c] else kids[c]
            deep[p] = max(deep[p], deep[c])
            waiting[p] -= 1
            if not waiting[p]:
                order.append(p)
    top = [-1] * len(ids)
    for c in reversed(order):
        p = up[c]
        top[c] = top[p] if p >= 0 and top[p] >= 0 else c if chosen[c] else -1
    top = np.array(top, np.int64)
    return ids, ids[top], (top >= 0).astype(np.int64), np.array(deep)


def _picked(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cluster, top)`` of the clusters under a chosen one, and ``(cluster, deep)``: the largest density below each.

    One task folds a tree of a checked number of clusters; larger ones take a round a level.
    """
    flat = cut(tree.select("cluster", F.coalesce("parent", "cluster").alias("parent"), "stability", "death"))
    got = None
    if flat.count() == flat.agg(F.count_distinct("cluster")).first()[0]:
        got = in_one_task(flat, _fold_tree, "cluster bigint, top bigint, has bigint, deep double")
    if got is None:
        return _tops(tree, _choose(tree)), _deepest(tree)
    got = cut(got)
    return got.filter("has = 1").select("cluster", "top"), got.select("cluster", "deep")


def _choose(tree: DataFrame) -> DataFrame:
    """``(cluster, best, self)``: the stability each subtree can reach, leaves first."""
    waiting = tree.select("cluster", "parent", "stability")
    done = None
    while True:
        open_parents = waiting.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("cluster")).distinct()
        ready = waiting.join(open_parents, "cluster", "left_anti")
        if done is not None:
            kids = done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("kids"))
            ready = ready.join(kids, "cluster", "left")
        else:
            ready = ready.withColumn("kids", F.lit(None).cast("double"))
        # the root of a tree is never a cluster of its own when it splits
        keep = F.col("kids").isNull() | ((F.col("stability") >= F.col("kids")) & F.col("parent").isNotNull())
        ready = cut(
            ready.select("cluster", "parent", keep.alias("self"), F.when(keep, F.col("stability")).otherwise(F.col("kids")).alias("best"))
        )
        if ready.isEmpty():
            return done.select("cluster", "best", "self")
        waiting = cut(waiting.join(ready.select("cluster"), "cluster", "left_anti"))
        done = ready if done is None else cut(done.unionByName(ready))


def _tops(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    up = tree.select("cluster", "parent").join(chosen.select("cluster", "self"), "cluster")
    # a cluster below another chosen one belongs to the upper one: follow parents upward and
    # keep the highest chosen ancestor, by dropping the links above chosen clusters whose
    # ancestors are not chosen
    path = cut(up.select(F.col("cluster").alias("id"), F.col("parent").alias("at"), F.when(F.col("self"), F.col("cluster")).alias("top")))
    while True:
        nxt = path.select(F.col("id").alias("__i"), F.col("at").alias("__at"), F.col("top").alias("__top"))
        path = cut(
            path.join(nxt, F.col("at") == F.col("__i"), "left").select(
                "id", F.col("__at").alias("at"), F.coalesce("__top", "top").alias("top")
            )
        )
        if path.filter(F.col("at").isNotNull()).isEmpty():
            break
    return path.filter(F.col("top").isNotNull()).select(F.col("id").alias("cluster"), "top")


def _deepest(tree: DataFrame) -> DataFrame:
    """The largest density found anywhere below each condensed cluster."""
    below = tree.select("cluster", "parent", "death")
    deepest = cut(below.select("cluster", "death"))
    link = cut(below.filter(F.col("parent").isNotNull()).select("cluster", "parent"))
    reach = deepest.select(F.col("cluster").alias("id"), F.col("cluster").alias("anc"), "death")
    step = link.select(F.col("cluster").alias("anc"), "parent")
    total = reach
    while True:
        reach = cut(
            reach.join(step, "anc").select("id", F.col("parent").alias("anc"), "death").groupBy("anc").agg(F.max("death").alias("death"))
            .withColumn("id", F.col("anc"))
        )
        if reach.isEmpty():
            break
        total = total.unionByName(reach.select("id", "anc", "death"))
    return total.groupBy(F.col("anc").alias("cluster")).agg(F.max("death").alias("deep"))


def _stable_labels(ix: BlockIndex, tree: DataFrame, picked: DataFrame, deepest: DataFrame, rows: DataFrame):
    members = rows.join(picked, "cluster", "left")
    firsts = members.filter(F.col("top").isNotNull()).groupBy("top").agg(F.min("pid").alias("first"), F.max("lam").alias("peak"))
    numbers, _, _ = numbered(firsts, F.col("first"), name="label")
    labelled = (
        members.join(numbers.select("top", F.col("label").cast("int").alias("label"), "peak"), "top", "left")
        .join(deepest, "cluster", "left")
        .select(
            "pid",
            F.coalesce("label", F.lit(-1)).alias("label"),
            F.when(F.col("top").isNull(), F.lit(0.0))
            .otherwise(F.least(F.col("lam"), F.col("peak")) / F.col("peak"))
            .alias("probability"),
            F.greatest(F.lit(0.0), F.lit(1.0) - F.col("lam") / F.greatest("deep", "lam")).alias("outlier_score"),
        )
    )
    table = tree.join(
        picked.filter(F.col("cluster") == F.col("top")).select("cluster", F.lit(True).alias("chosen")), "cluster", "left"
    ).withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return ix.spread(labelled).select("id", "label", "probability", "outlier_score"), table
