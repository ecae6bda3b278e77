"""Agglomerative clustering to a merge table.

Single linkage comes from the spanning forest and has no size limit. In the other linkages
pairs that are one another's nearest merge together in a round, which gives the same tree
as one merge at a time.

Ward's merge cost depends on the sizes and centres of two clusters only, so each round finds
the nearest clusters by a search on a block tree over the centres and has no size limit
either. Complete and average linkage are defined on all pairs of members. Up to ``pair_rows`` locations
they start from the table of all pairs. Beyond, a round searches the tree over the centres as well: two clusters are at least
as far apart, in either linkage, as their centres, so only clusters whose centres lie within the best known height are
measured on their members. The pairs of the last ``finish`` clusters are folded over all members, block by block, without a row per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.blocks import SLACK, BlockIndex, block_index, point_pairs, walk_pairs, with_points, within
from ..operators.components import compress, in_one_task
from ..operators.forest import merge_table
from ..operators.neighbours import knn_index, knn_join, location_knn
from ..operators.summaries import check_linkage
from ..session import batch_rows, cut, numbered, spread_over
from ..sources.points import with_dim

PAIR_ROWS = 20_000  # locations whose full pair table is accepted
FINISH_CLUSTERS = 2_000  # clusters whose last merges run in one task
CHUNK_ROWS = 1_024  # locations that a task meets with as many others at a time
MERGES = "turn bigint, left bigint, right bigint, made_i bigint, made_j bigint, height double, size bigint"


def single_linkage(points: DataFrame | BlockIndex) -> DataFrame:
    """Merge table of single linkage; a location with copies is one leaf of that size."""
    from ..operators.forest import reach_forest

    ix = knn_index(points, 8)
    zero = ix.points.select("pid", F.lit(0.0).alias("core_dist"))
    forest = cut(reach_forest(ix, zero, cut(location_knn(ix, 8))))
    return merge_table(ix.points.select(F.col("pid").alias("id"), "w"), forest)


def _ward_cost(n_i, n_j, d2):
    return n_i * n_j / (n_i + n_j) * d2


def _ward_nearest(parts: DataFrame, dim: int) -> DataFrame:
    """``(id, height, ci, cj)``: the cheapest merge of every cluster ``(label, n, ls)``, ties to the smaller ids.

    The cheapest merge inside the own block bounds the search. A node pair is dropped when
    the least size on either side at the gap of the boxes costs more than the largest bound.
    """
    at = cut(parts.select(F.col("label").alias("id"), "n", V.centre_of("ls", "n").alias("features")))
    ix = block_index(with_dim(at.select("id", "features"), dim))
    pts = cut(ix.points.select("pid", "block", "features").join(ix.copies().join(at.select("id", "n"), "id"), "pid"))
    p = pts.select("block", *[F.col(c).alias(f"p_{c}") for c in ("id", "n", "features")])
    q = pts.select(F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in ("id", "n", "features")])
    cost = _ward_cost(F.col("p_n"), F.col("q_n"), V.sqeuclidean("p_features", "q_features", dim))
    inner = p.join(q, F.col("block") == F.col("q_block")).filter(F.col("p_id") != F.col("q_id"))
    bound = inner.groupBy(F.col("p_id").alias("id")).agg(F.min(cost).alias("most"))
    pts = cut(pts.join(bound, "id").withColumn("w", F.lit(1)))
    ball = with_points(ix, pts, {"most": ("max", F.col("most")), "n": ("min", F.col("n"))})
    least = _ward_cost(F.col("a_n"), F.col("b_n"), F.col("gap2"))
    leaves, _ = walk_pairs(ball, ball, least <= F.col("a_most") * F.lit(1.0 + SLACK))
    boxes = leaves.select("a_node", "b_node", "b_lo", "b_hi", "b_n")
    p = pts.select("block", *[F.col(c).alias(f"p_{c}") for c in ("id", "n", "features", "most")])
    gap = V.box_gap2("p_features", "p_features", "b_lo", "b_hi", dim)
    reach = p.join(boxes, F.col("block") == F.col("a_node")).filter(
        _ward_cost(F.col("p_n"), F.col("b_n"), gap) <= F.col("p_most") * F.lit(1.0 + SLACK)
    )
    met = spread_over(reach.select("b_node", "p_id", "p_n", "p_features"), "b_node").join(q, F.col("b_node") == F.col("q_block"))
    pair = F.struct(cost.alias("height"), F.least("p_id", "q_id").alias("ci"), F.greatest("p_id", "q_id").alias("cj"))
    best = met.filter(F.col("p_id") != F.col("q_id")).groupBy(F.col("p_id").alias("id")).agg(F.min(pair).alias("b"))
    return best.select("id", "b.height", "b.ci", "b.cj")


def _one_by_one(turn: int, label, n, made, costs, join):
    """Greedy merges as columns of ``MERGES``; the cheapest pair first, ties to the smaller ids.

    Clusters come in order of their labels. ``costs(i, others)`` are heights, ``join(i, j)`` folds j into i.
    """
    size = len(label)
    table = np.full((size, size), np.inf)  # row < column
    for i in range(size - 1):
        table[i, i + 1 :] = costs(i, np.arange(i + 1, size))
    arg = table.argmin(axis=1)
    low = table[np.arange(size), arg]
    alive, out = np.ones(size, bool), []
    for step in range(size - 1):
        i = int(low.argmin())
        j = int(arg[i])
        out.append((turn + step, label[i], label[j], made[i], made[j], low[i], n[i] + n[j]))
        n[i], made[i], alive[j] = n[i] + n[j], turn + step, False
        join(i, j)
        table[j, :] = table[:, j] = np.inf
        low[j] = np.inf
        others = np.flatnonzero(alive)
        others = others[others != i]
        fresh = costs(i, others)
        table[np.minimum(others, i), np.maximum(others, i)] = fresh
        stale = alive & ((arg == i) | (arg == j))
        stale[i] = True
        rows = np.flatnonzero(stale)
        arg[rows] = table[rows].argmin(axis=1)
        low[rows] = table[rows, arg[rows]]
        up = others[others < i]
        better = (table[up, i] < low[up]) | ((table[up, i] == low[up]) & (i < arg[up]))
        low[up[better]], arg[up[better]] = table[up[better], i], i
    kinds = ("int64",) * 5 + ("float64", "int64")
    return [np.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 7, kinds)]


def _ward_finish(turn: int):
    """The greedy Ward merges of a checked number of clusters, as columns of ``MERGES``."""

    def fold(label, n, made, *ls):
        order = np.argsort(label)
        label, n, made = label[order], n[order].astype("int64"), made[order].astype("int64")
        ls = np.stack(ls, axis=1)[order]

        def costs(i, others):
            gap = ls[i] / n[i] - ls[others] / n[others, None]
            return _ward_cost(n[i], n[others], (gap * gap).sum(axis=1))

        def join(i, j):
            ls[i] += ls[j]

        return _one_by_one(turn, label, n, made, costs, join)

    return fold


def _mutual_merges(parts: DataFrame, best: DataFrame, turn: int) -> DataFrame:
    """The pairs that are one another's ``best (id, height, ci, cj)``, as merges of a turn."""
    mutual = best.groupBy("ci", "cj", "height").agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") == 2)
    a = parts.select(F.col("label").alias("ci"), F.col("n").alias("n_i"), F.col("made").alias("made_i"))
    b = parts.select(F.col("label").alias("cj"), F.col("n").alias("n_j"), F.col("made").alias("made_j"))
    met = mutual.join(a, "ci").join(b, "cj")
    size = (F.col("n_i") + F.col("n_j")).alias("size")
    return cut(met.select(F.lit(turn).cast("long").alias("turn"), F.col("ci").alias("left"), F.col("cj").alias("right"), "made_i", "made_j", "height", size))


def _merge_rounds(parts: DataFrame, dim: int, finish: int) -> DataFrame:
    """Ward merges ``MERGES`` of clusters ``(label, n, ls, made)`` by rounds of mutually cheapest pairs; the last
    ones, from ``finish`` clusters on, in one task."""
    merged, turn, left = None, 0, parts.count()
    while left > max(finish, 1):
        turn += 1
        new = _mutual_merges(parts, cut(_ward_nearest(parts, dim)), turn)
        merged = new if merged is None else merged.unionByName(new)
        parts = _joined_parts(parts, new, dim, turn)
        left = parts.count()
    if left > 1:
        flat = parts.select("label", "n", "made", *[F.col("ls")[i].alias(f"ls{i}") for i in range(dim)])
        last = in_one_task(flat, _ward_finish(turn + 1), MERGES, finish)
        merged = last if merged is None else merged.unionByName(last)
    return None if merged is None else cut(merged)


def _joined_parts(parts: DataFrame, new: DataFrame, dim: int, turn: int) -> DataFrame:
    into = new.select(F.col("right").alias("label"), F.col("left").alias("into"))
    named = parts.join(into, "label", "left").groupBy(F.coalesce("into", "label").alias("label")).agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.col("ls")[i]) for i in range(dim)]).alias("ls"),
        F.max("made").alias("made"),
        F.count(F.lit(1)).alias("k"),
    )
    made = F.when(F.col("k") > 1, F.lit(turn).cast("long")).otherwise(F.col("made"))
    return cut(named.select("label", "n", "ls", made.alias("made")))


def _member_heights(pairs: DataFrame, members: DataFrame, linkage: str, dim: int) -> DataFrame:
    """``(ci, cj, height)`` of the cluster pairs ``(ci, cj)``, over all pairs of their members ``(label, features, w)``."""
    a = members.select(F.col("label").alias("ci"), F.col("features").alias("p"), F.col("w").alias("p_w"))
    b = members.select(F.col("label").alias("cj"), F.col("features").alias("q"), F.col("w").alias("q_w"))
    met = spread_over(spread_over(pairs.select("ci", "cj"), "ci").join(a, "ci"), "cj").join(b, "cj")
    dist, both = V.euclidean("p", "q", dim), F.col("p_w") * F.col("q_w")
    height = F.sum(dist * both) / F.sum(both) if linkage == "average" else F.max(dist)
    return met.groupBy("ci", "cj").agg(height.alias("height"))


def _linkage_nearest(parts: DataFrame, members: DataFrame, linkage: str, dim: int, scale: float) -> DataFrame:
    """``(id, height, ci, cj)``: the nearest cluster of every cluster ``(label, n, ls)``, ties to the smaller ids.

    The height to the cluster of the nearest centre bounds the search. ``scale``, the largest coordinate, allows for the
    rounding of centres.
    """
    at = cut(parts.select(F.col("label").alias("id"), V.centre_of("ls", "n").alias("features")))
    ix = block_index(with_dim(at, dim))
    both = lambda a, b: [F.least(a, b).alias("ci"), F.greatest(a, b).alias("cj")]
    first = cut(knn_join(ix, 1).select(*both("id", "nbr")).distinct())
    known = cut(_member_heights(first, members, linkage, dim))
    ends = known.select(F.col("ci").alias("id"), "height").unionByName(known.select(F.col("cj").alias("id"), "height"))
    reach = F.min("height") * F.lit(1.0 + SLACK) + F.lit(scale * 1e-11)
    bound = ends.groupBy("id").agg(reach.alias("most"))
    pts = ix.points.select("pid", "block", "features").join(ix.copies(), "pid").join(bound, "id").withColumn("w", F.lit(1))
    pts = cut(pts)
    ball = with_points(ix, pts, {"most": ("max", F.col("most"))})
    leaves, _ = walk_pairs(ball, ball, within(F.col("a_most")))
    near = point_pairs(pts, pts, leaves, dim, F.col("p_most"), ["id", "most"], ["id"]).filter(F.col("p_id") != F.col("q_id"))
    more = near.select(*both("p_id", "q_id")).distinct().join(known.select("ci", "cj"), ["ci", "cj"], "left_anti")
    all_ = known.unionByName(_member_heights(cut(more), members, linkage, dim))
    pair = F.struct("height", "ci", "cj")
    ids = F.explode(F.array("ci", "cj"))
    best = all_.select(ids.alias("id"), "height", "ci", "cj").groupBy("id").agg(F.min(pair).alias("b"))
    return best.select("id", "b.height", "b.ci", "b.cj")


def _fold_chunks(linkage: str, dim: int):
    """Folds the pairs of members of two chunks of locations per pair of clusters; made here to travel by value."""
    fold = np.maximum if linkage == "complete" else np.add

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x, w, label, start = [], [], [], []
                for side in ("a", "b"):
                    column = lambda name: batch.column(f"{side}_{name}").slice(i, 1).flatten().to_numpy()
                    x.append(column("x").reshape(-1, dim))
                    w.append(column("w"))
                    every = column("label")
                    start.append(np.flatnonzero(np.append(True, every[1:] != every[:-1])))
                    label.append(every[start[-1]])
                dist = np.zeros((len(x[0]), len(x[1])))
                for d in range(dim):
                    dist += np.square(x[0][:, None, d] - x[1][None, :, d])
                np.sqrt(dist, out=dist)
                if linkage == "average":
                    dist *= w[0][:, None] * w[1][None, :]
                table = fold.reduceat(fold.reduceat(dist, start[0], axis=0), start[1], axis=1)
                a, b = np.repeat(label[0], len(label[1])), np.tile(label[1], len(label[0]))
                # chunks follow the labels: inside one chunk every pair stands twice
                keep = a < b
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(table.ravel()[keep])], ["ci", "cj", "s"])

    return run


def _cluster_pairs(members: DataFrame, linkage: str, dim: int) -> DataFrame:
    """``(ci, cj, s)`` of all pairs of clusters: the largest distance, or the sum of distances, over their members."""
    ranked, n, _ = numbered(members, F.col("label"), F.col("pid"), name="__rank")
    chunks = -(-n // CHUNK_ROWS)
    member = F.struct("__rank", "label", "w", "features")
    lists = ranked.groupBy(F.floor(F.col("__rank") / CHUNK_ROWS).alias("chunk")).agg(F.sort_array(F.collect_list(member)).alias("m"))
    lists = cut(
        lists.select(
            "chunk",
            F.col("m.label").alias("label"),
            F.transform("m.w", lambda v: v.cast("double")).alias("w"),
            F.flatten("m.features").alias("x"),
        )
    )
    side = lambda tag: lists.select(*[F.col(c).alias(f"{tag}_{c}") for c in lists.columns])
    pairs = members.sparkSession.range(chunks).select(
        F.col("id").alias("a_chunk"), F.explode(F.sequence("id", F.lit(chunks - 1).cast("bigint"))).alias("b_chunk")
    )
    met = spread_over(pairs.join(side("a"), "a_chunk").join(side("b"), "b_chunk"), "a_chunk", "b_chunk")
    with batch_rows(members.sparkSession, 16):
        met = met.select(*[f"{t}_{c}" for t in "ab" for c in ("label", "w", "x")])
        found = cut(met.mapInArrow(_fold_chunks(linkage, dim), "ci bigint, cj bigint, s double"))
    return found.groupBy("ci", "cj").agg((F.max if linkage == "complete" else F.sum)("s").alias("s"))


def _linkage_finish(turn: int, linkage: str):
    """The greedy merges of a checked number of clusters, as columns of ``MERGES``, from their pairs and, where ``ci = cj``, themselves."""

    def fold(ci, cj, s, n, made):
        own = ci == cj
        order = np.argsort(ci[own])
        label, n, made = ci[own][order], n[own][order].astype("int64"), made[own][order].astype("int64")
        table = np.zeros((len(label), len(label)))
        a, b = np.searchsorted(label, ci[~own]), np.searchsorted(label, cj[~own])
        table[a, b] = table[b, a] = s[~own]

        def costs(i, others):
            return table[i, others] / (n[i] * n[others]) if linkage == "average" else table[i, others]

        def join(i, j):
            table[i] = table[i] + table[j] if linkage == "average" else np.maximum(table[i], table[j])
            table[:, i] = table[i]

        return _one_by_one(turn, label, n, made, costs, join)

    return fold


def _linkage_rounds(parts: DataFrame, members: DataFrame, linkage: str, dim: int, finish: int) -> DataFrame | None:
    """Merges ``MERGES`` of clusters ``(label, n, ls, made)`` with ``members (pid, features, w, label)``, by rounds of mutually nearest
    clusters; the last ones, from ``finish`` clusters on, in one task."""
    x = F.col("features")
    box = members.agg(*[F.max(F.abs(x[i])) for i in range(dim)]).first()
    scale = max((float(v) for v in box), default=0.0)
    merged, turn, left = None, 0, parts.count()
    while left > max(finish, 1):
        turn += 1
        new = _mutual_merges(parts, cut(_linkage_nearest(parts, members, linkage, dim, scale)), turn)
        merged = new if merged is None else merged.unionByName(new)
        parts = _joined_parts(parts, new, dim, turn)
        into = new.select(F.col("right").alias("label"), F.col("left").alias("into"))
        members = cut(members.join(into, "label", "left").select("pid", "features", "w", F.coalesce("into", "label").alias("label")))
        left = parts.count()
    if left > 1:
        none = F.lit(0).cast("bigint")
        own = parts.select(F.col("label").alias("ci"), F.col("label").alias("cj"), F.lit(0.0).alias("s"), "n", "made")
        pairs = _cluster_pairs(members, linkage, dim).select("ci", "cj", "s", none.alias("n"), none.alias("made"))
        last = in_one_task(cut(own.unionByName(pairs)), _linkage_finish(turn + 1, linkage), MERGES, finish * (finish + 1) // 2)
        merged = last if merged is None else merged.unionByName(last)
    return None if merged is None else cut(merged)


def _height(linkage: str):
    n = F.col("n_i") * F.col("n_j")
    if linkage == "average":
        return F.col("s") / n
    return F.col("s")


def agglomerate(
    points: DataFrame | BlockIndex, linkage: str, pair_rows: int = PAIR_ROWS, finish: int = FINISH_CLUSTERS
) -> DataFrame:
    """``(step, left, right, left_step, right_step, height, size)``, n - 1 rows.

    ``left`` and ``right`` are the smallest ids of the parts, ``*_step`` the merge that made
    them (0 for a leaf). For Ward the height is the growth of the summed squared error.
    Copies of a location are one leaf. ``pair_rows`` bounds the table of all pairs from which complete and average linkage
    start; more locations are searched through the block tree. ``finish`` is the number of clusters from which that search, and
    Ward, merge one pair at a time in one task.
    """
    check_linkage(linkage)
    if linkage == "single":
        return single_linkage(points)
    ix = knn_index(points, 8)
    dim = ix.dim
    parts = cut(
        ix.points.select(
            F.col("pid").alias("label"),
            F.col("w").alias("n"),
            F.transform("features", lambda v: v * F.col("w")).alias("ls"),
            F.lit(0).cast("long").alias("made"),
        )
    )
    if linkage == "ward":
        return _merge_steps(_merge_rounds(parts, dim, finish))
    if ix.n > pair_rows:
        members = cut(ix.points.select("pid", "features", "w", F.col("pid").alias("label")))
        return _merge_steps(_linkage_rounds(parts, members, linkage, dim, finish))
    leaves, _ = walk_pairs(ix, ix, F.lit(True))
    near = point_pairs(ix.points, ix.points, leaves, dim, float("inf"), ["pid", "w"], ["pid", "w"])
    near = near.filter(F.col("p_pid") < F.col("q_pid"))
    start = F.col("dist") * F.col("p_w") * F.col("q_w") if linkage == "average" else F.col("dist")
    pairs = cut(near.select(F.col("p_pid").alias("ci"), F.col("q_pid").alias("cj"), start.alias("s")))
    fold = {"complete": F.max, "average": F.sum}[linkage]
    merged, turn = None, 0
    while not pairs.isEmpty():
        turn += 1
        a = parts.select(F.col("label").alias("ci"), F.col("n").alias("n_i"), F.col("ls").alias("ls_i"), F.col("made").alias("made_i"))
        b = parts.select(F.col("label").alias("cj"), F.col("n").alias("n_j"), F.col("ls").alias("ls_j"), F.col("made").alias("made_j"))
        full = pairs.join(a, "ci").join(b, "cj")
        full = full.withColumn("height", _height(linkage))
        both = full.select(F.col("ci").alias("id"), "height", "ci", "cj").unionByName(
            full.select(F.col("cj").alias("id"), "height", "ci", "cj")
        )
        best = both.groupBy("id").agg(F.min(F.struct("height", "ci", "cj")).alias("b"))
        mutual = (
            best.groupBy(F.col("b.ci").alias("ci"), F.col("b.cj").alias("cj"), F.col("b.height").alias("height"))
            .agg(F.count(F.lit(1)).alias("votes"))
            .filter(F.col("votes") == 2)
            .drop("votes")
        )
        new = cut(
            mutual.join(a.drop("ls_i"), "ci").join(b.drop("ls_j"), "cj").select(
                F.lit(turn).alias("turn"),
                F.col("ci").alias("left"),
                F.col("cj").alias("right"),
                "made_i",
                "made_j",
                "height",
                (F.col("n_i") + F.col("n_j")).alias("size"),
            )
        )
        merged = new if merged is None else cut(merged.unionByName(new))
        into = new.select(F.col("right").alias("label"), F.col("left").alias("into"))
        parts = _joined_parts(parts, new, dim, turn)
        ia = into.select(F.col("label").alias("ci"), F.col("into").alias("ti"))
        ib = into.select(F.col("label").alias("cj"), F.col("into").alias("tj"))
        named = pairs.join(ia, "ci", "left").join(ib, "cj", "left").select(
            F.coalesce("ti", "ci").alias("x"), F.coalesce("tj", "cj").alias("y"), "s"
        )
        pairs = cut(
            named.filter(F.col("x") != F.col("y"))
            .groupBy(F.least("x", "y").alias("ci"), F.greatest("x", "y").alias("cj"))
            .agg(fold("s").alias("s"))
        )
    return _merge_steps(merged)


def _merge_steps(merged: DataFrame | None) -> DataFrame:
    """Merges in order of height with the steps that made their parts."""
    if merged is None:
        raise ValueError("one location has nothing to merge")
    steps, _, _ = numbered(merged, F.col("height"), F.col("turn"), F.col("left"), name="pos")
    steps = steps.withColumn("step", F.col("pos") + 1)
    ref_l = steps.select(F.col("left").alias("__l"), F.col("turn").alias("__t"), F.col("step").alias("left_step"))
    ref_r = steps.select(F.col("left").alias("__r"), F.col("turn").alias("__u"), F.col("step").alias("right_step"))
    out = steps.join(ref_l, (F.col("left") == F.col("__l")) & (F.col("made_i") == F.col("__t")), "left").join(
        ref_r, (F.col("right") == F.col("__r")) & (F.col("made_j") == F.col("__u")), "left"
    )
    zero = F.lit(0).cast("bigint")
    return out.select(
        "step", "left", "right", F.coalesce("left_step", zero).alias("left_step"),
        F.coalesce("right_step", zero).alias("right_step"), "height", "size",
    )


def cut_merges(vertices: DataFrame, merges: DataFrame, k: int | None = None, height: float | None = None) -> DataFrame:
    """``(id, label)`` after keeping the merges up to a height, or all but the last ``k - 1``."""
    if (k is None) == (height is None):
        raise ValueError("give either k or height")
    if height is not None:
        kept = merges.filter(F.col("height") <= F.lit(float(height)))
    else:
        last = vertices.count() - k
        kept = merges.filter(F.col("step") <= F.lit(last))
    hooks = kept.select(F.col("right").alias("id"), F.col("left").alias("parent"))
    rows = vertices.select("id").join(hooks, "id", "left").select("id", F.coalesce("parent", "id").alias("parent"))
    return compress(rows).select("id", F.col("root").alias("label"))


def merge_levels(merges: DataFrame, n: int) -> DataFrame:
    """``(step, n_clusters, height)``: the list of merges as it would be titled step by step."""
    return merges.select("step", (F.lit(n) - F.col("step")).alias("n_clusters"), "height")
