"""Minimum spanning forests and the merge tables read off them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut, numbered
from .blocks import BlockIndex, point_pairs, spread_over, walk_pairs, with_points
from .components import compress, connected_components, in_one_task, relabel
from .neighbours import PairsWithin, location_knn

CHUNK_EDGES = 200_000  # forest edges whose merges are ordered inside one task
CONTRACT_PLACES = 50_000  # neighbouring locations whose sure edges are followed inside one task


def _picks_to_roots(picks: DataFrame) -> DataFrame:
    """``(id, root)`` from each component's pick ``(id, other)``; picks follow one total order,
    so the only cycles are pairs that picked each other."""
    back = picks.select(F.col("id").alias("__o"), F.col("other").alias("__back"))
    joined = picks.join(back, F.col("other") == F.col("__o"), "left")
    mutual = F.coalesce(F.col("__back") == F.col("id"), F.lit(False))
    parent = F.when(mutual & (F.col("id") < F.col("other")), F.col("id")).otherwise(F.col("other"))
    known = joined.select("id", parent.alias("parent"))
    # a picked component that made no pick of its own is a root
    loose = picks.select(F.col("other").alias("id")).distinct().join(picks.select("id"), "id", "left_anti")
    return compress(known.unionByName(loose.select("id", F.col("id").alias("parent"))))


def _best_edges(edges: DataFrame) -> DataFrame:
    """The least edge of each component: ``(id, other, w, src, dst)`` from ``(cs, cd, w, src, dst)``."""
    both = edges.select(F.col("cs").alias("id"), F.col("cd").alias("other"), "w", "src", "dst").unionByName(
        edges.select(F.col("cd").alias("id"), F.col("cs").alias("other"), "w", "src", "dst")
    )
    return (
        both.groupBy("id")
        .agg(F.min(F.struct("w", "src", "dst", "other")).alias("b"))
        .select("id", F.col("b.other").alias("other"), F.col("b.w").alias("w"), F.col("b.src").alias("src"), F.col("b.dst").alias("dst"))
    )


def _thin(edges: DataFrame) -> DataFrame:
    """Drop inner edges and keep the least edge between two components."""
    return (
        edges.filter(F.col("cs") != F.col("cd"))
        .groupBy(F.least("cs", "cd").alias("cs"), F.greatest("cs", "cd").alias("cd"))
        .agg(F.min(F.struct("w", "src", "dst")).alias("b"))
        .select("cs", "cd", F.col("b.w").alias("w"), F.col("b.src").alias("src"), F.col("b.dst").alias("dst"))
    )


def _kruskal(cs, cd, w, src, dst):
    """The edges of the forest among the components that contracted edges ``cs, cd`` link."""
    ids, ends = np.unique(np.concatenate([cs, cd]), return_inverse=True)
    order = np.lexsort((dst, src, w))
    up = list(range(len(ids)))
    kept = []
    for i, a, b in zip(order.tolist(), ends[: len(cs)][order].tolist(), ends[len(cs) :][order].tolist(), strict=True):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(i)
    return src[kept], dst[kept], w[kept]


def _forest_within(pairs: PairsWithin) -> DataFrame:
    """The forest of pairs by distance: the rows of a place hang on its smallest id, places are linked through the box tree."""
    ix = pairs.index(8)
    if ix is None:
        return spanning_forest(pairs.listed().withColumnRenamed("dist", "w"))
    zero = ix.points.select("pid", F.lit(0.0).alias("core_dist"))
    forest = reach_forest(ix, zero, cut(location_knn(ix, 8)), pairs.max_dist)
    if not ix.has_copies or pairs.max_dist < 0:
        return forest
    own = ix.copies().filter(F.col("id") != F.col("pid"))
    return forest.unionByName(own.select(F.col("pid").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w")))


def spanning_forest(edges: DataFrame | PairsWithin) -> DataFrame:
    """Minimum spanning forest ``(src, dst, w)`` of weighted edges, by rounds of least edges.

    Ties go to the smaller ``(src, dst)``. Edges between the same two components are
    folded to one after every round; the last of them, up to a checked number, are finished in one task.
    Pairs by distance need not be listed.
    """
    if isinstance(edges, PairsWithin):
        return _forest_within(edges)
    cur = cut(
        _thin(
            edges.select(
                F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("w").cast("double").alias("w")
            ).select(F.col("src").alias("cs"), F.col("dst").alias("cd"), "w", "src", "dst")
        )
    )
    out = None
    while not cur.isEmpty():
        got = in_one_task(cur, _kruskal, "src bigint, dst bigint, w double")
        if got is not None:
            got = cut(got)
            return got if out is None else out.unionByName(got)
        best = cut(_best_edges(cur))
        got = best.select("src", "dst", "w").distinct()
        out = got if out is None else out.unionByName(got)
        roots = _picks_to_roots(best.select("id", "other"))
        cur = cut(_thin(relabel(cur, roots, "cs", "cd")))
    if out is None:
        return cur.select("src", "dst", "w")
    return out


def _all_at_one_level(ix: BlockIndex, verts: DataFrame) -> bool:
    """Whether every location stands once in ``verts`` and all have the same core distance."""
    c = F.col("core_dist")
    n, ids, low, high = verts.agg(F.count(F.lit(1)), F.count_distinct("pid"), F.min(c), F.max(c)).first()
    return n == ids == ix.n and low == high


def _contractor():
    """The function that follows the sure edges of one bounded range of locations; made here to travel by value.

    Edges come in their order. The least edge of a component belongs to the forest while it is no longer than
    the component's floor; a component whose least edge leaves the range, or is longer than its floor, waits.
    """

    def contract(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["w", "src", "dst"])
        here = np.concatenate([rows["cs"][rows["in_s"]], rows["cd"][rows["in_d"]]])
        ids, first = np.unique(here, return_index=True)
        floor = np.concatenate([rows["fs"][rows["in_s"]], rows["fd"][rows["in_d"]]])[first].tolist()
        ends = [np.where(rows[i], np.searchsorted(ids, rows[c]), -1).tolist() for c, i in (("cs", "in_s"), ("cd", "in_d"))]
        up = list(range(len(ids)))
        waits = [False] * len(ids)
        kept = []
        for i, (x, y, w) in enumerate(zip(*ends, rows["w"].tolist(), strict=True)):
            if x < 0 or y < 0:
                x = max(x, y)
                while up[x] != x:
                    up[x] = x = up[up[x]]
                waits[x] = True
                continue
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x == y:
                continue
            waits[x] |= not w <= floor[x]
            waits[y] |= not w <= floor[y]
            if waits[x] and waits[y]:
                continue
            x, y = min(x, y), max(x, y)
            up[y] = x
            waits[x] |= waits[y]
            floor[x] = min(floor[x], floor[y])
            kept.append(i)
        for x in range(len(up)):  # a root is the smallest of its component, so it is settled before the others
            up[x] = up[up[x]]
        edges = rows[["src", "dst", "w"]].iloc[kept].rename(columns={"src": "a", "dst": "b"}).assign(edge=True)
        return pd.concat([edges, pd.DataFrame({"a": ids, "b": ids[up], "w": 0.0, "edge": False})])

    return contract


def _contract(ix: BlockIndex, verts: DataFrame, cur: DataFrame, floors: DataFrame):
    """``(forest edges, roots)`` of the sure edges inside ranges of the curve, many rounds of merging at once."""
    at = verts.select("pid", F.floor(F.col("rank") / F.lit(CONTRACT_PLACES)).alias("g")).join(floors, F.col("pid") == F.col("id")).drop("id")
    s, d = (at.select(F.col("pid").alias(c), F.col("g").alias(f"g_{c}"), F.col("floor").alias(f)) for c, f in (("cs", "fs"), ("cd", "fd")))
    met = cur.join(s, "cs").join(d, "cd")
    met = met.withColumn("g", F.explode(F.array_distinct(F.array("g_cs", "g_cd"))))
    met = met.select("g", "cs", "cd", "w", "src", "dst", "fs", "fd", (F.col("g") == F.col("g_cs")).alias("in_s"), (F.col("g") == F.col("g_cd")).alias("in_d"))
    got = cut(met.groupBy("g").applyInPandas(_contractor(), "a bigint, b bigint, w double, edge boolean"))
    return (
        got.filter("edge").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"),
        got.filter(~F.col("edge")).select(F.col("a").alias("id"), F.col("b").alias("root")),
    )


def reach_forest(ix: BlockIndex, core: DataFrame, knn: DataFrame, max_dist: float | None = None) -> DataFrame:
    """Minimum spanning forest of the locations under max(core a, core b, distance).

    ``core`` is ``(pid, core_dist)``, NULL for locations to leave out; ``knn`` is
    ``(pid, nbr, dist)`` with the same number of neighbours for all; edges longer than
    ``max_dist`` do not exist. While the neighbour lists prove the least edge of a
    component, components merge by them alone, first inside ranges of the curve, each in one
    task. After that the box tree looks for edges
    shorter than the best known edge of a component; node pairs inside one component, or
    further apart than that bound, are dropped unseen. On a line with one core distance
    for all, the steps from each location to the next are the forest.
    """
    verts = cut(
        ix.points.join(core.filter(F.col("core_dist").isNotNull()), "pid").withColumn("comp", F.col("pid"))
    )
    lists = knn.groupBy("pid").agg(F.max("dist").alias("far"))
    a = verts.select("pid", F.col("core_dist").alias("ca"))
    b = verts.select(F.col("pid").alias("nbr"), F.col("core_dist").alias("cb"))
    near = knn.join(a, "pid").join(b, "nbr")
    w = F.greatest("ca", "cb", "dist")
    seeds = near.select(F.least("pid", "nbr").alias("src"), F.greatest("pid", "nbr").alias("dst"), w.alias("w"))
    following = verts.select((F.col("rank") - 1).alias("rank"), F.col("pid").alias("nbr"), F.col("core_dist").alias("cb"), F.col("features").alias("fb"))
    steps = (
        verts.join(following, "rank")
        .withColumn("dist", V.euclidean("features", "fb", ix.dim))
        .select(
            F.least("pid", "nbr").alias("src"),
            F.greatest("pid", "nbr").alias("dst"),
            F.greatest("core_dist", "cb", "dist").alias("w"),
        )
    )
    if ix.dim == 1 and _all_at_one_level(ix, verts):
        return steps if max_dist is None else steps.filter(F.col("w") <= F.lit(float(max_dist)))
    seeds = seeds.unionByName(steps)
    if max_dist is not None:
        seeds = seeds.filter(F.col("w") <= F.lit(float(max_dist)))
    limit = F.lit(float("inf") if max_dist is None else float(max_dist))
    cur = cut(_thin(seeds.select(F.col("src").alias("cs"), F.col("dst").alias("cd"), "w", "src", "dst")))
    # no unlisted neighbour of a point is nearer than its list reaches
    floors = verts.join(lists, "pid", "left").select(
        F.col("pid").alias("id"), F.greatest("core_dist", F.coalesce("far", F.lit(0.0))).alias("floor")
    )
    comps = verts.select("pid", F.col("pid").alias("comp"))
    out, roots = _contract(ix, verts, cur, cut(floors.groupBy("id").agg(F.min("floor").alias("floor"))))
    cur = cut(_thin(relabel(cur, roots, "cs", "cd")))
    floors = cut(relabel(floors, roots, "id").groupBy("id").agg(F.min("floor").alias("floor")))
    comps = cut(relabel(comps, roots, "comp"))
    while True:
        best = cut(_best_edges(cur).join(floors, "id", "left").withColumn("sure", F.col("w") <= F.col("floor")))
        picks = best.filter("sure")
        if picks.isEmpty():
            break
        out = out.unionByName(picks.select("src", "dst", "w").distinct())
        roots = _picks_to_roots(picks.select("id", "other"))
        cur = cut(_thin(relabel(cur, roots, "cs", "cd")))
        floors = relabel(floors, roots, "id").groupBy("id").agg(F.min("floor").alias("floor"))
        floors, comps = cut(floors), relabel(comps, roots, "comp")
    best = best.select("id", "other", "w", "src", "dst")
    verts = cut(verts.drop("comp").join(comps, "pid"))
    while True:
        found = cut(_shorter_edges(ix, verts, best, limit))
        picks = cut(_best_edges(_thin(cur.unionByName(found))))
        if picks.isEmpty():
            break
        out = out.unionByName(picks.select("src", "dst", "w").distinct())
        roots = _picks_to_roots(picks.select("id", "other"))
        cur = cut(_thin(relabel(cur.unionByName(found), roots, "cs", "cd")))
        if max_dist is None and cur.isEmpty():
            break  # the seeds link all locations, so one component is left
        verts = cut(relabel(verts, roots, "comp"))
        best = cut(_best_edges(cur))
    return out.distinct()


def _shorter_edges(ix: BlockIndex, verts: DataFrame, best: DataFrame, limit) -> DataFrame:
    """For each component its least edge that is shorter than the best known one."""
    bound = F.least(F.coalesce("w", limit), limit)
    pts = cut(
        verts.drop("w").withColumnRenamed("core_dist", "core")
        .join(best.select(F.col("id").alias("comp"), "w"), "comp", "left")
        .withColumn("open", F.col("w").isNull())
        .withColumn("bound", bound)
        .drop("w")
        .withColumn("w", F.lit(1).cast("bigint"))
    )
    tree = with_points(
        ix,
        pts,
        {
            "c0": ("min", F.col("comp")),
            "c1": ("max", F.col("comp")),
            "bound": ("max", F.col("bound")),
            "core": ("min", F.col("core")),
        },
    )
    same = (F.col("a_c0") == F.col("a_c1")) & (F.col("b_c0") == F.col("b_c1")) & (F.col("a_c0") == F.col("b_c0"))
    low = F.greatest(F.sqrt("gap2"), "a_core", "b_core")
    # components without any known edge may still use one as long as the limit itself
    leaves, _ = walk_pairs(tree, tree, ~same & (low <= F.col("a_bound")))
    near = point_pairs(pts, pts, leaves, ix.dim, F.col("p_bound"), ["pid", "comp", "core", "bound", "open"], ["pid", "comp", "core"])
    w = F.greatest("dist", "p_core", "q_core")
    ok = (w < F.col("p_bound")) | (F.col("p_open") & (w <= F.col("p_bound")))
    near = near.filter(F.col("p_comp") != F.col("q_comp")).filter(ok)
    return near.groupBy(F.col("p_comp").alias("cs")).agg(
        F.min(
            F.struct(w.alias("w"), F.least("p_pid", "q_pid").alias("src"), F.greatest("p_pid", "q_pid").alias("dst"), F.col("q_comp").alias("cd"))
        ).alias("b")
    ).select("cs", F.col("b.cd").alias("cd"), F.col("b.w").alias("w"), F.col("b.src").alias("src"), F.col("b.dst").alias("dst"))


def _chunk_orderer():
    """The function that orders the merges of one bounded chunk of edges.

    It is made here so that it travels to the workers by value.
    """

    def order(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("step")
        names, ends = np.unique(np.concatenate([rows["a"], rows["b"]]), return_inverse=True)
        a, b = ends[: len(rows)], ends[len(rows) :]
        known = []
        for kind in ("low", "size", "made"):
            of = np.zeros(len(names), np.int64)
            of[a], of[b] = rows[f"a{kind}"], rows[f"b{kind}"]
            known.append(of.tolist())
        low, size, made = known
        up = list(range(len(names)))
        out = []
        for step, w, x, y in zip(rows["step"].tolist(), rows["w"].tolist(), a.tolist(), b.tolist(), strict=True):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if low[y] <= low[x]:
                x, y = y, x
            out.append((step, low[x], low[y], made[x], made[y], w, size[x] + size[y]))
            up[y] = x
            size[x] += size[y]
            made[x] = step
        cols = ["step", "left", "right", "left_step", "right_step", "height", "size"]
        return pd.DataFrame(out, columns=cols)

    return order


MERGE_SCHEMA = "step bigint, left bigint, right bigint, left_step bigint, right_step bigint, height double, size bigint"


def merge_table(vertices: DataFrame, forest: DataFrame, chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """Single-linkage merges of a forest: ``(step, left, right, left_step, right_step, height, size)``.

    Steps count from 1 by height. ``left`` and ``right`` are the smallest ids of the two
    parts, ``left`` the smaller; ``*_step`` is the merge that made the part, 0 for a single
    row. ``vertices`` has ``id`` and the weight ``w``. Ordering the merges of a tree is
    sequential, so the sorted edges are halved: the light half falls apart into pieces,
    which are contracted for the heavy half, until every piece has at most
    ``chunk_edges`` edges; pieces are then ordered side by side.
    """
    edges, m, _ = numbered(forest, F.col("w"), F.col("src"), F.col("dst"), name="step")
    edges = edges.withColumn("step", F.col("step") + 1)
    verts = vertices.select("id", F.col("id").alias("low"), F.col("w").alias("size"), F.lit(0).cast("bigint").alias("made"))
    a = verts.select(*[F.col(c).alias(n) for c, n in (("id", "a"), ("low", "alow"), ("size", "asize"), ("made", "amade"))])
    b = verts.select(*[F.col(c).alias(n) for c, n in (("id", "b"), ("low", "blow"), ("size", "bsize"), ("made", "bmade"))])
    work = edges.withColumnRenamed("src", "a").withColumnRenamed("dst", "b").join(a, "a").join(b, "b")
    work = cut(work.withColumn("piece", F.lit(0).cast("bigint")))
    done = None
    while m > chunk_edges:
        # split each large piece at its middle step
        stats = work.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("step", 0.5, 10_000).alias("mid"))
        tagged = work.join(stats, "piece")
        small = cut(tagged.filter(F.col("n") <= chunk_edges).drop("n", "mid"))
        done = small if done is None else done.unionByName(small)
        large = cut(tagged.filter(F.col("n") > chunk_edges))
        if large.isEmpty():
            work = None
            break
        light = large.filter(F.col("step") <= F.col("mid")).drop("n", "mid")
        heavy = large.filter(F.col("step") > F.col("mid")).drop("n", "mid")
        # a contracted part is named by one of its rows, so a name is distinct only inside its piece
        own = lambda side: F.struct("piece", F.col(side).alias("id"))
        ends = light.select(own("a").alias("id")).unionByName(light.select(own("b").alias("id"))).distinct()
        comps = connected_components(ends, light.select(own("a").alias("src"), own("b").alias("dst")))
        comps = cut(comps.select("id.piece", "id.id", F.col("component.id").alias("component")))
        light = light.join(comps.withColumnRenamed("id", "a"), ["piece", "a"])
        ends_info = light.select("piece", F.col("a").alias("id"), "alow", "asize").unionByName(
            light.select("piece", F.col("b").alias("id"), F.col("blow").alias("alow"), F.col("bsize").alias("asize"))
        ).distinct()
        pieces = cut(
            ends_info.join(comps, ["piece", "id"]).groupBy("piece", "component").agg(F.min("alow").alias("clow"), F.sum("asize").alias("csize"))
            .join(light.groupBy("piece", "component").agg(F.max("step").alias("cmade")), ["piece", "component"])
        )
        into = comps.join(pieces, ["piece", "component"])
        for side in ("a", "b"):
            t = into.select(
                "piece",
                F.col("id").alias(side),
                F.col("component").alias("__c"),
                F.col("clow").alias("__l"),
                F.col("csize").alias("__s"),
                F.col("cmade").alias("__m"),
            )
            heavy = (
                heavy.join(t, ["piece", side], "left")
                .withColumn(side, F.coalesce("__c", side))
                .withColumn(f"{side}low", F.coalesce("__l", f"{side}low"))
                .withColumn(f"{side}size", F.coalesce("__s", f"{side}size"))
                .withColumn(f"{side}made", F.coalesce("__m", f"{side}made"))
                .drop("__c", "__l", "__s", "__m")
            )
        # a light piece is named by its last step, the heavy part keeps its own name shifted
        light = light.withColumn("piece", F.xxhash64("piece", "component")).drop("component")
        heavy = heavy.withColumn("piece", F.xxhash64("piece", F.lit("rest")))
        cols = work.columns
        work = cut(light.select(*cols).unionByName(heavy.select(*cols)))
        m = work.groupBy("piece").count().agg(F.max("count")).first()[0] or 0
    if done is not None:
        work = done if work is None else work.unionByName(done)
    return spread_over(work, "piece").groupBy("piece").applyInPandas(_chunk_orderer(), MERGE_SCHEMA)


def cut_forest(vertices: DataFrame, forest: DataFrame, height: float | None = None, k: int | None = None) -> DataFrame:
    """``(id, component)`` after cutting the forest at a height, or into ``k`` parts.

    For ``k`` parts the ``k - 1`` longest edges go (more when the forest is in pieces
    already they count as parts).
    """
    if (height is None) == (k is None):
        raise ValueError("give either height or k")
    if height is not None:
        kept = forest.filter(F.col("w") <= F.lit(float(height)))
    else:
        edges, m, _ = numbered(forest, F.col("w"), F.col("src"), F.col("dst"), name="__pos")
        n = vertices.count()
        kept = edges.filter(F.col("__pos") < F.lit(max(n - k, 0)))
    return connected_components(vertices, kept)


def members_of_step(vertices: DataFrame, merges: DataFrame, step: int) -> DataFrame:
    """Rows of the cluster made at a step: ``(id)``.

    A merge at or before ``step`` hooks its right part to its left part, both by their
    smallest ids, so following the hooks names every row's cluster at that step.
    """
    hooks = merges.filter(F.col("step") <= step).select(F.col("right").alias("id"), F.col("left").alias("parent"))
    rows = vertices.select("id").join(hooks, "id", "left").select("id", F.coalesce("parent", "id").alias("parent"))
    roots = compress(rows)
    head = merges.filter(F.col("step") == step).select(F.col("left").alias("root"))
    return roots.join(head, "root").select("id")
