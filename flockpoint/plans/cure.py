"""Representative-based clustering, on the whole table or on a sample.

The closest two clusters by representatives merge, one pair after the other, until ``k`` are left. Merges far from one
another do not touch, so they are made side by side: a phase takes a distance and makes all merges below it. Clusters that
are that near form a region. Every later representative lies between the representatives and means of the clusters it came from,
so two regions whose boxes are further apart than the distance cannot meet in this phase; nearer ones are joined first.
Each region is then a merge problem of its own, solved in one bounded group, and the order of the merges of different regions
follows from their distances. The result is the one-by-one result for every table size; phases and
groups change speed only.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.assign import assign_nearest
from ..operators.components import compress, connected_components
from ..operators.neighbours import index_of, knn_index, location_knn, row_pairs
from ..session import attach, cut, numbered, spread_over
from ..sources.points import dim_of, sample_n, with_dim

GROUP = 20_000  # clusters of a region that one task merges
FLAT_GROUP = 200_000  # the same in up to GRID_DIMS dimensions
GRID_DIMS = 3
DENSE = 3_000  # clusters that are compared with all others; more are first met through a grid
LEVELS = 40  # sizes of cells that boxes are put into


def sample_size(n_rows: int, k: int, u_min: int | None = None, f: float = 0.3, d: float = 0.02) -> int:
    """Sample rows by the Chernoff rule, loosening ``f`` and then ``d`` until it fits the table."""
    u_min = u_min if u_min is not None else round(n_rows / k)
    while True:
        risk = math.log(1 / d)
        need = f * n_rows + n_rows / u_min * risk + n_rows / u_min * math.sqrt(risk * risk + 2 * f * u_min * risk)
        if math.ceil(need) <= n_rows:
            return math.ceil(need)
        if f >= 0.19:
            f -= 0.1
        else:
            d *= 2
            if d >= 1:
                return n_rows


SCHEMA = "region bigint, old bigint, cid bigint, n bigint, ls array<double>, reps array<array<double>>, turn int, gap double, peak double"


def _side(dist: float, size: float) -> float:
    """Width of a cell such that points closer than ``dist`` lie in neighbouring cells, however large (``size``) their coordinates are."""
    return dist * (1 + 1e-9) + size * 1e-14


def _close_pairs(at: np.ndarray, owner: np.ndarray, dist: float, most: int):
    """``(u, v, d)``: owners ``u < v`` of points ``at`` closer than ``dist``, their least distance; None where over ``most`` pairs of points share cells."""
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)[: at.shape[1]]
    cell = np.floor((at - at.min(axis=0)) / _side(dist, np.abs(at).max())).astype(np.int64)
    key = (cell.view(np.uint64) * odd).sum(axis=1, dtype=np.uint64)  # a step to the next cell adds the same to every key
    order = np.argsort(key, kind="stable")
    at, owner, key = at[order], owner[order], key[order]
    found, met = [], 0
    for off in itertools.product((0, 1, -1), repeat=at.shape[1]):
        if off < (0,) * len(off):
            continue  # the other cell meets this one
        there = key + (np.array(off).view(np.uint64) * odd).sum(dtype=np.uint64)
        lo, hi = np.searchsorted(key, there, "left"), np.searchsorted(key, there, "right")
        if not any(off):
            lo = np.arange(1, len(key) + 1)
        n = hi - lo
        met += int(n.sum())
        if met > most:
            return None
        a = np.repeat(np.arange(len(key)), n)
        found.append((a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + lo[a]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    d = (at[a, 0] - at[b, 0]) ** 2
    for i in range(1, at.shape[1]):
        d += (at[a, i] - at[b, i]) ** 2
    d = np.sqrt(d)
    near = (d < dist) & (owner[a] != owner[b])
    u, v, d = np.minimum(owner[a], owner[b])[near], np.maximum(owner[a], owner[b])[near], d[near]
    order = np.lexsort((d, v, u))
    u, v, d = u[order], v[order], d[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[first], v[first], d[first]


def _places(reps: list) -> tuple[np.ndarray, np.ndarray]:
    names = [i for i, r in enumerate(reps) if r is not None]
    return np.vstack([reps[i] for i in names]), np.repeat(names, [len(reps[i]) for i in names])


def _next_distance(reps: list, dist: float, below: float):
    """A distance beyond ``dist``, ``below`` at most, up to which a cluster has a few neighbours, and the pairs that are closer; None if there is none."""
    at, owner = _places(reps)
    wide = float((at.max(axis=0) - at.min(axis=0)).max())
    step, top = max(dist * 1.4, 0.3 * wide * len(at) ** (-1 / at.shape[1])), math.inf
    for _ in range(100):
        step = min(step, below)
        pairs = _close_pairs(at, owner, step, 64 * len(at)) if step > dist else None
        if pairs is None or len(pairs[0]) > 8 * len(at):
            step, top = (dist + step) / 2, step
        elif len(pairs[0]) or step >= below:
            return step, pairs
        else:
            step = min(step * 1.5, (step + top) / 2)
    return None


def _merged_in_cells(reps: list, dist: float, pairs, merge, go_on) -> None:
    """Merge the closest pair closer than ``dist``, one after the other, until none is left: the order of the dense search.

    ``merge(u, v, gap)`` puts ``v`` into ``u``, ``go_on()`` tells whether another merge is wanted. Representatives stand in a grid of cells as
    wide as ``dist``, so a new cluster meets its surroundings only.
    """
    names = [i for i, r in enumerate(reps) if r is not None]
    side, dim = _side(dist, max(np.abs(reps[i]).max() for i in names)), reps[names[0]].shape[1]
    cells: dict[tuple, list] = {}
    around = list(itertools.product((-1, 0, 1), repeat=dim))

    def spots(i):
        return [(tuple(k), tuple(x)) for k, x in zip(np.floor(reps[i] / side).astype(np.int64).tolist(), reps[i].tolist(), strict=True)]

    for i in names:
        for k, x in dict.fromkeys(spots(i)):
            cells.setdefault(k, []).append((i, x))
    age = dict.fromkeys(names, 0)
    heap = [(d, u, v, 0, 0) for u, v, d in zip(*(x.tolist() for x in pairs), strict=True)]
    heapq.heapify(heap)
    while heap and go_on():
        gap, u, v, a, b = heapq.heappop(heap)
        if age.get(u) != a or age.get(v) != b:
            continue
        for i in (u, v):
            for k in {k for k, _ in spots(i)}:
                cells[k] = [x for x in cells[k] if x[0] != i]
        del age[v]
        merge(u, v, gap)
        age[u] += 1
        least: dict[int, float] = {}
        fresh = list(dict.fromkeys(spots(u)))
        for k, x in fresh:
            for off in around:
                for w, y in cells.get(tuple(map(int.__add__, k, off)), ()):
                    far = 0.0
                    for i in range(dim):
                        far += (x[i] - y[i]) * (x[i] - y[i])
                    if far < least.get(w, math.inf):
                        least[w] = far
        for w, far in least.items():
            far = math.sqrt(far)
            if far < dist:
                heapq.heappush(heap, (far, u, w, age[u], age[w]) if u < w else (far, w, u, age[w], age[u]))
        for k, x in fresh:
            cells.setdefault(k, []).append((u, x))


def _region_merger(c: int, alpha: float, below: float, dense: int = DENSE):
    """The function that merges the clusters of regions one by one; made here to travel by value.

    Where more than ``dense`` clusters are left, in few dimensions, the closest pair is found through a grid.
    A cluster that was absorbed tells at which ``turn`` of its region, at what distance, and the largest distance up to then.
    """

    def spread(pool, mid):
        """Up to ``c`` far-apart rows of ``pool``, moved toward ``mid``."""
        if len(pool) > c:
            picked = [int(np.argmax(((pool - mid) ** 2).sum(1)))]
            while len(picked) < c:
                far = np.sqrt(((pool[:, None, :] - pool[picked][None, :, :]) ** 2).sum(-1)).sum(1)
                far[picked] = -1.0
                picked.append(int(np.argmax(far)))
            pool = pool[picked]
        return pool + alpha * (mid - pool)

    def solve(rows: pd.DataFrame, most: float):
        n = len(rows)
        reps = [np.array([list(r) for r in v], dtype=float) for v in rows["reps"]]
        size = rows["n"].to_numpy().copy()
        sums = [np.array(v, dtype=float) for v in rows["ls"]]
        dim = reps[0].shape[1]
        home, told = np.arange(n), np.full((n, 3), np.nan)
        turn, peak = 0, 0.0

        def join(u: int, v: int, gap: float):
            nonlocal turn, peak
            turn += 1
            peak = max(peak, gap)
            told[v] = turn, gap, peak
            size[u] += size[v]
            sums[u] = sums[u] + sums[v]
            reps[u] = spread(np.vstack([reps[u], reps[v]]), sums[u] / size[u])
            reps[v] = None
            home[v] = u

        reached = 0.0
        while dim <= GRID_DIMS and n - turn > dense and turn < most and reached < below:
            further = _next_distance(reps, reached, below)
            if further is None:
                break
            reached, pairs = further
            _merged_in_cells(reps, reached, pairs, join, lambda: turn < most and n - turn > dense)
        name = np.array([i for i in range(n) if reps[i] is not None])  # the cluster at each place
        m = len(name)
        # unused places are filled with the first representative again
        wide = max(c, max(len(reps[i]) for i in name))
        table = np.empty((dim, wide, m))

        def place(i: int, at: int):
            table[:, : len(reps[i]), at] = reps[i].T
            table[:, len(reps[i]) :, at] = reps[i][0][:, None]

        def gaps(i: int, since: int):
            """Distance of cluster ``i`` from the clusters at places ``since`` and later."""
            best = None
            pool = reps[i][:1] if (reps[i] == reps[i][0]).all() else reps[i]
            for p in pool:
                if dim < 8:
                    far = (table[0, :, since:m] - p[0]) ** 2
                    for a in range(1, dim):
                        off = table[a, :, since:m] - p[a]
                        off *= off
                        far += off
                else:
                    far = ((np.moveaxis(table[:, :, since:m], 0, -1) - p) ** 2).sum(-1)
                far = far.min(0)
                best = far if best is None else np.minimum(best, far, out=best)
            return np.sqrt(best)

        # a pair stands at its smaller place; only the nearest later cluster of each is kept
        near, least = np.zeros(m, np.int64), np.full(m, np.inf)

        def search(at: int):
            least[at] = np.inf
            if at + 1 < m:
                d = gaps(name[at], at + 1)
                best = int(np.argmin(d))
                near[at], least[at] = at + 1 + best, d[best]

        for at, i in enumerate(name.tolist()):
            place(i, at)
        for i in range(m):
            search(i)
        alive, left = np.ones(m, bool), m
        while turn < most:
            at = int(np.argmin(least[:m]))
            gap = least[at]
            if not gap < below:
                break
            gone = int(near[at])
            u, v = int(name[at]), int(name[gone])
            join(u, v, gap)
            place(u, at)
            table[:, :, gone] = np.inf
            alive[gone] = False
            least[gone] = np.inf
            left -= 1
            stale = np.flatnonzero(alive[:m] & ((near[:m] == at) | (near[:m] == gone)))
            d = gaps(u, 0)
            before, known = d[:at], least[:at]
            closer = np.flatnonzero((before < known) | ((before == known) & (at < near[:at])))
            sure = set(np.flatnonzero(before < known).tolist())
            near[closer], least[closer] = at, d[closer]
            for w in {at, *stale.tolist()} - sure:
                search(w)
            if left < m / 2:  # close up the places of absorbed clusters
                keep = np.flatnonzero(alive[:m])
                moved = np.zeros(m, np.int64)
                moved[keep] = np.arange(left)
                table = np.ascontiguousarray(table[:, :, keep])
                name, least, near, alive, m = name[keep], least[keep], moved[near[keep]], alive[keep], left
        for v in np.argsort(-np.nan_to_num(told[:, 0])).tolist():  # whoever took a cluster in leaves later, if at all
            home[v] = home[home[v]]
        return home, size, sums, reps, told

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for region, part in rows.groupby("region"):
            part = part.sort_values("cid").reset_index(drop=True)
            home, size, sums, reps, told = solve(part, float(part["most"].iloc[0]))
            names = part["cid"].to_numpy()
            for i, h in enumerate(home.tolist()):
                while_merged = (int(told[i, 0]), float(told[i, 1]), float(told[i, 2])) if told[i, 0] == told[i, 0] else (None, None, None)
                own = (int(size[h]), sums[h].tolist(), reps[h].tolist()) if i == h else (0, None, None)
                out.append((int(region), int(names[i]), int(names[h]), *own, *while_merged))
        table = pd.DataFrame(out, columns=["region", "old", "cid", "n", "ls", "reps", "turn", "gap", "peak"])
        return table.astype({"turn": "Int32"})

    return merge


def _solved(clusters: DataFrame, regions: DataFrame, most: DataFrame | float, c: int, alpha: float, below: float, groups: int) -> DataFrame:
    """Merge the clusters of each region ``(cid, region)`` below a distance; ``most`` bounds the merges, per region or in all."""
    rows = clusters.join(regions, "cid")
    if isinstance(most, DataFrame):
        rows = rows.join(most, "region")
    else:
        rows = rows.withColumn("most", F.lit(float(most)))
    rows = spread_over(rows, "region").withColumn("deal", F.pmod(F.xxhash64("region"), F.lit(groups)))
    return cut(rows.groupBy("deal").applyInPandas(_region_merger(c, alpha, below), SCHEMA))


def _box_links(boxes: DataFrame, points: DataFrame, below: float, dim: int) -> DataFrame:
    """``(src, dst)``: regions of ``boxes (region, lo, hi)`` and owners of ``points (region, lo, hi)`` that boxes come near.

    A box is put into cells of the first power of two that covers it and the distance, so it meets a few cells; whatever it may meet is
    put into the cells of all such sizes in use.
    """
    axes = range(min(dim, 2))
    least = math.floor(math.log2(below)) if below > 0 else -LEVELS
    extent = F.greatest(F.lit(2.0**least), *[F.col("hi")[i] - F.col("lo")[i] for i in axes])
    level = F.least(F.ceil(F.log2(extent)), F.lit(least + LEVELS)).cast("int")
    boxes = cut(boxes.withColumn("level", F.greatest(level, F.lit(least + 1))))
    used = [r[0] for r in boxes.select("level").distinct().collect()]  # at most LEVELS numbers

    def cells(df: DataFrame, room: float) -> DataFrame:
        side = F.pow(F.lit(2.0), F.col("level"))
        for i in axes:
            first, last = F.floor((F.col("lo")[i] - F.lit(room)) / side), F.floor((F.col("hi")[i] + F.lit(room)) / side)
            df = df.withColumn(f"cell{i}", F.explode(F.sequence(first, last)))
        return df

    keys = ["level", *[f"cell{i}" for i in axes]]
    left = cells(boxes, below * (1 + 1e-9)).select(*keys, F.col("region").alias("src"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    everything = boxes.unionByName(points.withColumn("level", F.lit(least + 1)))
    levels = F.filter(F.array(*[F.lit(x) for x in sorted(used)]), lambda x: x >= F.col("level"))
    right = cells(everything.withColumn("level", F.explode(levels)), 0.0)
    right = right.select(*keys, F.col("region").alias("dst"), "lo", "hi")
    met = left.join(right, keys).filter(F.col("src") != F.col("dst"))
    return met.filter(V.box_gap2("alo", "ahi", "lo", "hi", dim) <= F.lit(below * below * (1 + 1e-9))).select("src", "dst").distinct()


def _near_clusters(clusters: DataFrame, below: float, dim: int) -> DataFrame:
    """``(src, dst, dist)``: clusters with representatives closer than ``below``, once per pair."""
    reps = clusters.select("cid", F.explode("reps").alias("features")).distinct()
    rows, _, _ = numbered(reps, F.col("cid"), F.col("features"), name="id")
    ix = index_of(with_dim(rows.select("id", "features"), dim))
    owner = rows.select("id", "cid")
    pairs = row_pairs(ix, below).filter((F.col("src") < F.col("dst")) & (F.col("dist") < F.lit(below)))
    pairs = pairs.join(owner.select(F.col("id").alias("src"), F.col("cid").alias("a")), "src")
    pairs = pairs.join(owner.select(F.col("id").alias("dst"), F.col("cid").alias("b")), "dst").filter(F.col("a") != F.col("b"))
    both = pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return cut(both.agg(F.min("dist").alias("dist")))


def _regions(clusters: DataFrame, near: DataFrame, below: float, dim: int) -> DataFrame:
    """``(cid, region)`` of the clusters that merges below a distance may touch."""
    active = near.select(F.col("src").alias("id")).unionByName(near.select(F.col("dst").alias("id"))).distinct()
    regions = cut(connected_components(active, near).select(F.col("id").alias("cid"), F.col("component").alias("region")))
    corners = clusters.select("cid", F.concat("reps", F.array(V.centre_of("ls", "n"))).alias("at"), "reps")
    while True:
        inside = corners.join(regions, "cid").select("region", F.explode("at").alias("x"))
        boxes = inside.groupBy("region").agg(V.per_dim(F.min, "x", dim).alias("lo"), V.per_dim(F.max, "x", dim).alias("hi"))
        outside = corners.join(regions, "cid", "left_anti").select(F.col("cid").alias("region"), F.explode("reps").alias("lo"))
        links = cut(_box_links(boxes, outside.withColumn("hi", F.col("lo")), below, dim))
        if links.isEmpty():
            return regions
        ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
        joined = cut(connected_components(ends, links).select(F.col("id").alias("region"), "component"))
        known = regions.join(joined, "region", "left").select("cid", F.coalesce("component", "region").alias("region"))
        fresh = joined.join(regions.select("region").distinct(), "region", "left_anti")
        regions = cut(known.unionByName(fresh.select(F.col("region").alias("cid"), F.col("component").alias("region"))))


def _mutual(near: DataFrame) -> DataFrame:
    """``(cid, region)``: pairs that are each other's nearest, each a region."""
    both = near.select(F.col("src").alias("cid"), "dist", "src", "dst").unionByName(near.select(F.col("dst").alias("cid"), "dist", "src", "dst"))
    best = both.groupBy("cid").agg(F.min(F.struct("dist", "src", "dst")).alias("b"))
    votes = best.groupBy("b").agg(F.count(F.lit(1)).alias("votes")).filter("votes = 2")
    return votes.select(F.explode(F.array("b.src", "b.dst")).alias("cid"), F.col("b.src").alias("region"))


def merge_representatives(
    points: DataFrame, k: int, c: int = 4, alpha: float = 0.1, group: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(members, clusters)``: ``(id, cid)`` and ``(cid, n, ls, reps)`` for ``k`` clusters, as by merging the closest pair each time.

    Ties go to the smaller ids. A cluster is named by its smallest row; its representatives are ``c`` of its parts'
    representatives, the first farthest from the mean, each next with the largest summed distance from those taken, all moved
    toward the mean by ``alpha``. Copies of a location are one cluster from the start, so there are never more
    clusters than locations.

    ``group`` is ``FLAT_GROUP`` in up to ``GRID_DIMS`` dimensions, else ``GROUP``. A region of more than ``group`` clusters below a
    distance makes the phase try a shorter one. Where no distance tells clusters apart (more than ``group`` of them at one
    distance in a row, as on a lattice), mutually nearest pairs merge side by side.
    """
    ix = knn_index(points, 1)
    dim, count = ix.dim, ix.n
    group = group or (FLAT_GROUP if dim <= GRID_DIMS else GROUP)
    copies = F.least("w", F.lit(c)).cast("int")
    clusters = cut(
        ix.points.select(
            F.col("pid").alias("cid"),
            F.col("w").cast("bigint").alias("n"),
            F.transform("features", lambda v: v * F.col("w")).alias("ls"),
            F.array_repeat("features", copies).alias("reps"),
        )
    )
    hooks, done, grow = None, 0.0, 1.5
    below = None
    if count > group:
        below = location_knn(ix, 1).agg(F.percentile_approx("dist", 0.5, 1000)).first()[0] * (1 + 1e-12)
    while count > k:
        rest = clusters.select("cid", F.lit(0).cast("bigint").alias("region"))
        if count <= group:
            out = _solved(clusters, rest, count - k, c, alpha, math.inf, 1)
        else:
            near = _near_clusters(clusters, below, dim)
            regions, limit = (None, 0) if near.isEmpty() else (_regions(clusters, near, below, dim), 1)
            if regions is None:
                done, below, grow = below, below * grow, min(grow * 1.5, 8.0)
                continue
            largest, active = regions.groupBy("region").count().agg(F.max("count"), F.sum("count")).first()
            if largest > group:
                least = near.agg(F.min("dist")).first()[0] * (1 + 1e-9)
                if below > least:
                    below, grow = max((done + below) / 2, least), max(1 + (grow - 1) / 2, 1.05)
                    continue
                regions, limit = cut(_mutual(near)), 2
                active = regions.count()
            groups = max(-(-2 * active // group), 1)
            out = _solved(clusters, regions, math.inf if limit == 1 else 1, c, alpha, below, groups)
            made = out.filter(F.col("turn").isNotNull()).count()
            if made > count - k:
                # the order of all merges: a region's next one comes up once its earlier ones are made
                order, _, _ = numbered(out.filter(F.col("turn").isNotNull()), F.col("peak"), F.col("region"), F.col("turn"), name="at")
                first = order.filter(F.col("at") < F.lit(count - k)).groupBy("region").agg(F.count(F.lit(1)).cast("double").alias("most"))
                out = _solved(clusters, regions, cut(first), c, alpha, below, groups)
            if limit == 1:
                done = below
                below = below * grow
                grow = min(grow * 1.2, 4.0) if made < 0.05 * count else grow
        moved = out.filter(F.col("turn").isNotNull()).select(F.col("old").alias("id"), F.col("cid").alias("parent"))
        hooks = moved if hooks is None else cut(hooks.unionByName(moved))
        kept = out.filter(F.col("turn").isNull()).select("cid", "n", "ls", "reps")
        clusters = cut(clusters.join(out.select(F.col("old").alias("cid")), "cid", "left_anti").unionByName(kept))
        count = clusters.count()
    at = ix.points.select(F.col("pid").alias("id"))
    if hooks is None:
        named = at.select(F.col("id").alias("pid"), F.col("id").alias("cid"))
    else:
        roots = compress(at.join(hooks, "id", "left").select("id", F.coalesce("parent", "id").alias("parent")))
        named = roots.select(F.col("id").alias("pid"), F.col("root").alias("cid"))
    return cut(ix.spread(cut(named))), clusters


def cure(points: DataFrame, k: int, c: int = 4, alpha: float = 0.1, group: int | None = None, part_rows: int | None = None):
    """``(labels, reps)``: ``(id, label)`` from 0 by smallest member, and ``(label, rep)``.

    ``part_rows`` is the former name of ``group``; as before it counts as ``8 k`` at least.
    """
    if part_rows is not None:
        group = max(part_rows, 8 * k)
    members, clusters = merge_representatives(points, k, c, alpha, group)
    order, _, _ = numbered(clusters, F.col("cid"), name="label")
    named = order.withColumn("label", F.col("label").cast("int"))
    labels = attach(members, named.select("cid", "label", "n"), "cid", "n", by="id").select("id", "label")
    return labels, named.select("label", F.explode("reps").alias("rep"))


def cure_sampled(
    points: DataFrame, k: int, c: int = 4, alpha: float = 0.3, u_min: int | None = None, f: float = 0.3, d: float = 0.02,
    n_reps: int | None = None, group: int | None = None, seed: int = 42,
):
    """The same on a Chernoff-sized sample; every row then takes the label of its nearest
    representative: ``(labels, reps)`` with labels ``(id, label, dist)``."""
    n = sample_size(points.count(), k, u_min, f, d)
    sample = cut(sample_n(points, n, seed))
    _, reps = cure(sample.withMetadata("features", {"dim": dim_of(points)}), k, c, alpha, group)
    rows, _, _ = numbered(reps, F.col("label"), F.xxhash64("rep", F.lit(seed)), name="center")
    if n_reps is not None:
        from pyspark.sql import Window as W

        pick = F.row_number().over(W.partitionBy("label").orderBy("center"))
        rows = rows.withColumn("__r", pick).filter(F.col("__r") <= n_reps).drop("__r")
    rows = cut(rows)
    near = cut(assign_nearest(points, rows.select("center", F.col("rep").alias("features"))))
    taken = near.groupBy("center").agg(F.count(F.lit(1)).alias("n")).join(rows.select("center", "label"), "center")
    labels = attach(near, taken, "center", "n", by="id").select("id", "label", "dist")
    return labels, rows.select("label", "rep")
