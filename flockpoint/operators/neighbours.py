"""Neighbourhood operators: fixed radius, k nearest, counts and core distances.

All of them work on distinct locations with weights and use the block tree, so neither
copies nor dense spots make one task large.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import apart_in_unions, attach, batch_rows, cut, shared_path, spread_over
from ..sources.points import dim_of, with_dim
from .blocks import (
    FANOUT_BITS,
    BlockIndex,
    block_index,
    flat_index,
    inside,
    point_pairs,
    walk_pairs,
    with_points,
    within,
)

ROWS_PER_ENTRY = 1_024  # rows of one location that travel as one list
TREE_DIMS = 16  # in more dimensions boxes prune next to nothing, and all locations are met
CHUNK_ROWS = 2_048  # locations that a task meets at a time
GROUP_CHUNKS = 16  # chunks at most whose nearest a task keeps
SCANS = 64  # groups of chunks that a job searches for
#: A reader holds a row group at a time; the writer looks at its size after every row, as rows are long lists.
SMALL_ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 4, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.max": 16, "parquet.block.size.row.check.max": 16}


def index_of(points: DataFrame | BlockIndex) -> BlockIndex:
    return points if isinstance(points, BlockIndex) else block_index(points)


def eps_pairs(points: DataFrame | BlockIndex, eps: float) -> DataFrame:
    """Location pairs within ``eps``: ``(src, dst, dist, src_w, dst_w)``, self pairs included.

    Rows that share a location are one entry with a weight; ``copies()`` of the index
    lists them.
    """
    ix = index_of(points)
    leaves, _ = walk_pairs(ix, ix, within(eps))
    pairs = point_pairs(ix.points, ix.points, leaves, ix.dim, eps, ["pid", "w"], ["pid", "w"])
    return pairs.select(
        F.col("p_pid").alias("src"),
        F.col("q_pid").alias("dst"),
        "dist",
        F.col("p_w").alias("src_w"),
        F.col("q_w").alias("dst_w"),
    )


def _row_points(ix: BlockIndex) -> DataFrame:
    """The points of ``ix`` with the rows there as ``ids``, and a ``part``: a location of more than ``ROWS_PER_ENTRY`` rows is several entries."""
    if not ix.has_copies:
        return ix.points.select("block", "pid", "features", F.lit(0).cast("bigint").alias("part"), F.array(F.struct(F.col("pid").alias("id"))).alias("ids"))
    rows = attach(ix.copies(), ix.points.groupBy("pid").agg(F.sum("w").alias("w")), "pid", "w")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("w") / F.lit(ROWS_PER_ENTRY)))
    ids = rows.groupBy("pid", part.alias("part")).agg(F.collect_list(F.struct("id")).alias("ids"))
    return cut(ix.points.select("block", "pid", "features").join(ids, "pid"))


def _repeats(rows: DataFrame) -> bool:
    """Whether an id stands in several rows."""
    return not rows.groupBy("id").count().filter("count > 1").isEmpty()


def _listed(pairs: DataFrame, *keep: str, **ends: str) -> DataFrame:
    """Columns ``keep`` and one row per row of the lists: ``ends`` maps a column of lists to its row column."""
    for rows, row in ends.items():
        rest = [F.col(c) for c in pairs.columns if c != rows]
        pairs = pairs.select(*rest, F.explode(rows).alias("__row")).withColumn(row, F.col("__row.id")).drop("__row")
    return pairs.select(*ends.values(), *keep)


def eps_join(left: DataFrame | BlockIndex, right: DataFrame | BlockIndex, eps: float) -> DataFrame:
    """For each row of ``left`` its neighbours in ``right``: ``(left_id, right_id, dist)``.

    The pairs are found between locations that carry lists of their rows, so no pair of
    rows is shuffled.
    """
    a, b = index_of(left), index_of(right)
    leaves, _ = walk_pairs(a, b, within(eps))
    pairs = point_pairs(_row_points(a), _row_points(b), leaves, a.dim, eps, ["ids"], ["ids"])
    return _listed(pairs.select("p_ids", "q_ids", "dist"), "dist", p_ids="left_id", q_ids="right_id")


def row_pairs(points: DataFrame | BlockIndex, eps: float) -> DataFrame:
    """Row pairs within ``eps`` in both directions, self pairs and copies included: ``(src, dst, dist)``."""
    ix = index_of(points)
    return eps_join(ix, ix, eps).withColumnsRenamed({"left_id": "src", "right_id": "dst"})


def sorted_neighbours(points: DataFrame | BlockIndex, eps: float) -> DataFrame:
    """Neighbours of each row, itself included, nearest first: ``(src, rank, dst, dist)``.

    The rows of a location have one list, which is ranked once and then given to each of them. Where an id
    stands in several rows, their neighbours are ranked together.
    """
    ix = index_of(points)
    if ix.has_copies and _repeats(ix.rows):
        order = W.partitionBy("src").orderBy("dist", "dst")
        return row_pairs(ix, eps).select("src", F.row_number().over(order).alias("rank"), "dst", "dist")
    pts = _row_points(ix)
    leaves, _ = walk_pairs(ix, ix, within(eps))
    pairs = point_pairs(pts, pts, leaves, ix.dim, eps, ["pid", "part"], ["ids"]).select("p_pid", "p_part", "q_ids", "dist")
    lists = _listed(pairs, "p_pid", "p_part", "dist", q_ids="dst")
    order = W.partitionBy("p_pid", "p_part").orderBy("dist", "dst")
    ranked = lists.withColumn("rank", F.row_number().over(order))
    if not ix.has_copies:
        return ranked.select(F.col("p_pid").alias("src"), "rank", "dst", "dist")
    rows = pts.select(F.col("pid").alias("p_pid"), F.col("part").alias("p_part"), "ids")
    return _listed(ranked.join(rows, ["p_pid", "p_part"]), "rank", "dst", "dist", ids="src")


def _cascade(ix: BlockIndex, own: DataFrame, fold, name: str) -> DataFrame:
    """Bring per-node values ``(level, node, name)`` down to the leaf blocks, folding on the way."""
    carried = None
    for level in range(len(ix.nodes) - 1, -1, -1):
        here = own.filter(F.col("level") == level).select("node", name)
        if carried is not None:
            below = ix.nodes[level].select("node", F.shiftright("node", FANOUT_BITS).alias("__up"))
            handed = below.join(carried.withColumnRenamed("node", "__up"), "__up").select("node", name)
            here = here.unionByName(handed).groupBy("node").agg(fold(name).alias(name))
        carried = here
    return carried


def location_counts(ix: BlockIndex, eps: float, enough: int | None = None) -> DataFrame:
    """Rows within ``eps`` of each location, itself included: ``(pid, n_neigh)``.

    Node pairs that lie wholly within ``eps`` add their row counts without looking at
    points. With ``enough`` given, blocks that reach it that way are not counted further
    and report at least ``enough``.
    """
    leaves, settled = walk_pairs(ix, ix, within(eps), inside(eps))
    credits = cut(settled.groupBy("level", F.col("a_node").alias("node")).agg(F.sum("b_w").alias("credit")))
    credit = cut(_cascade(ix, credits, F.sum, "credit"))
    if enough is not None:
        full = credit.filter(F.col("credit") >= enough).select(F.col("node").alias("a_node"))
        leaves = leaves.join(full, "a_node", "left_anti")
    near = point_pairs(ix.points, ix.points, leaves, ix.dim, eps, ["pid"], ["w"])
    counted = near.groupBy(F.col("p_pid").alias("pid")).agg(F.sum("q_w").alias("n"))
    base = ix.points.select("pid", F.col("block").alias("node")).join(credit, "node", "left")
    return base.join(counted, "pid", "left").select(
        "pid", (F.coalesce("credit", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_neigh")
    )


def neighbour_counts(points: DataFrame | BlockIndex, eps: float) -> DataFrame:
    """``(id, n_neigh)``: rows within ``eps`` of each row, the row itself included."""
    ix = index_of(points)
    return ix.spread(location_counts(ix, eps))


def core_points(points: DataFrame | BlockIndex, eps: float, min_pts: int) -> DataFrame:
    """Rows with at least ``min_pts`` rows within ``eps`` (itself counted)."""
    return neighbour_counts(points, eps).filter(F.col("n_neigh") >= min_pts)


def core_points_excluding_self(points: DataFrame | BlockIndex, eps: float, min_pts: int) -> DataFrame:
    """The same rule stated on the neighbours other than the row itself."""
    return (
        neighbour_counts(points, eps)
        .select("id", (F.col("n_neigh") - 1).alias("n_others"))
        .filter(F.col("n_others") >= min_pts - 1)
    )


class _Nearest:
    """The ``k`` nearest of the locations met so far, for each of a group of locations; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.mid = x.mean(axis=0)
        self.flat = (x - self.mid).astype(np.float32)
        self.norm = np.square(x - self.mid).sum(axis=1)
        self.dist = np.full((len(x), k), np.inf)
        self.near = np.full((len(x), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        z = y - self.mid
        norm = np.square(z).sum(axis=1)
        for at in range(0, len(self.x), CHUNK_ROWS):
            own = slice(at, at + CHUNK_ROWS)
            # single precision tells who cannot be among the nearest, what is left is measured as it is
            rows, cols = self._near(own, self.flat[own] @ z.astype(np.float32).T, norm, 1e-4)
            if len(rows) > len(ids) * 64:
                rows, cols = self._near(own, (self.x[own] - self.mid) @ z.T, norm, 1e-12)
            for i in range(0, len(rows), 1 << 16):
                self._keep(rows[i : i + (1 << 16)] + at, cols[i : i + (1 << 16)], ids, y)

    def _near(self, own: slice, inner: np.ndarray, norm: np.ndarray, error: float):
        sizes = self.norm[own]
        slack = (error * (sizes + norm.max())).astype(inner.dtype)
        square = sizes.astype(inner.dtype)[:, None] + norm.astype(inner.dtype)[None, :] - 2 * inner
        most = np.square(self.dist[own, -1])
        if not np.isfinite(most).all() and square.shape[1] > self.k:
            # one of the k + 1 nearest may be the location itself
            most = np.minimum(most, np.partition(square, self.k, axis=1)[:, self.k] + slack)
        return np.nonzero(square <= (most * (1 + error) + slack)[:, None])

    def _keep(self, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        other = self.ids[rows] != ids[cols]
        rows, cols = rows[other], cols[other]
        gap = self.x[rows] - y[cols]
        dist = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        better = dist <= self.dist[rows, -1]
        rows, cols, dist = rows[better], cols[better], dist[better]
        open_ = np.unique(rows)
        who = np.concatenate([np.repeat(open_, self.k), rows])
        dist = np.concatenate([self.dist[open_].ravel(), dist])
        near = np.concatenate([self.near[open_].ravel(), ids[cols]])
        order = np.lexsort((near, dist, who))
        first = np.searchsorted(who[order], open_)
        best = order[first[:, None] + np.arange(self.k)]
        self.dist[open_], self.near[open_] = dist[best], near[best]

    def found(self) -> pa.RecordBatch:
        some = np.isfinite(self.dist)
        owner = np.repeat(self.ids, some.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(self.near[some]), pa.array(self.dist[some])], ["pid", "nbr", "dist"])


def _pieces(dim: int):
    """Lists of the locations ``(rank, pid, features)`` of one chunk that follow one another."""

    def run(batches):
        for batch in batches:
            chunk = batch.column("rank").to_numpy() // CHUNK_ROWS
            first = np.flatnonzero(np.diff(chunk, prepend=-1))
            ids, x = batch.column("pid"), batch.column("features").flatten()
            for at, to in zip(first.tolist(), [*first[1:].tolist(), len(chunk)], strict=True):
                own = slice(at, to)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk[at : at + 1]), pa.array([ids[own].to_numpy()]), pa.array([x[at * dim : to * dim].to_numpy()])], ["chunk", "ids", "x"]
                )

    return run


def _nearest_in_group(k: int, dim: int):
    """Meets a group's own lists with themselves and then with every other list, as they come; other lists wait until the own ones (``of``) are there."""

    def run(batches):
        group, own, waiting, state = None, [], [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column("g")[0].as_py() != group:
                    if state is not None:
                        yield state.found()
                    group, own, waiting, state = row.column("g")[0].as_py(), [], [], None
                part = row.column("ids").flatten().to_numpy(), row.column("x").flatten().to_numpy().reshape(-1, dim)
                if state is not None:
                    state.meet(*part)
                    continue
                (waiting if row.column("other")[0].as_py() else own).append(part)
                if len(own) == row.column("of")[0].as_py():
                    state = _Nearest(*(np.concatenate(c) for c in zip(*own, strict=True)), k)
                    for part in own + waiting:
                        state.meet(*part)
                    own, waiting = [], []
        if state is not None:
            yield state.found()

    return run


def _knn_of_all(ix: BlockIndex, k: int) -> DataFrame:
    """``location_knn`` by meeting all locations chunk by chunk, each task with a group of chunks and what is nearest to them so far.

    Every task reads the table of lists by itself, its own chunks first, so that nothing is shuffled or written but the table and the result.
    """
    spark = ix.points.sparkSession
    chunks = -(-ix.n // CHUNK_ROWS)
    per = min(max(-(-chunks // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))), 1), GROUP_CHUNKS)
    kind = "chunk bigint, ids array<bigint>, x array<double>"
    path = shared_path(spark)
    lists = ix.points.select("rank", "pid", "features").mapInArrow(_pieces(ix.dim), kind)
    lists.write.options(**SMALL_ROW_GROUPS).parquet(path)
    lists = spark.read.schema(kind).parquet(path)
    group = F.floor(F.col("chunk") / per)
    sizes = sorted((r["g"], r["count"]) for r in lists.groupBy(group.alias("g")).count().collect())
    found = []
    for at in range(0, len(sizes), SCANS):
        scans = []
        for g, n in sizes[at : at + SCANS]:
            mine = F.col("chunk").between(g * per, (g + 1) * per - 1)
            both = lists.filter(mine).withColumn("other", F.lit(False)).unionByName(lists.filter(~mine).withColumn("other", F.lit(True)))
            scans.append(both.coalesce(1).select(F.lit(g).alias("g"), F.lit(n).alias("of"), "other", "ids", "x"))
        with batch_rows(spark, 4), apart_in_unions(spark):
            found.append(cut(reduce(DataFrame.unionAll, scans).mapInArrow(_nearest_in_group(k, ix.dim), "pid bigint, nbr bigint, dist double")))
    return reduce(DataFrame.unionAll, found)


def location_knn(ix: BlockIndex, k: int) -> DataFrame:
    """The ``k`` nearest other locations: ``(pid, nbr, dist)``, ties to the smaller id.

    In more than ``TREE_DIMS`` dimensions all locations are met, chunk by chunk. Else a block holds at least ``k + 1`` locations, so the k-th distance inside the block
    bounds the search ball of each point; the tree then finds the blocks the balls
    reach.
    """
    if ix.n <= 1:
        return ix.points.select("pid", F.col("pid").alias("nbr"), F.lit(0.0).alias("dist")).limit(0)
    if ix.dim > TREE_DIMS:
        return _knn_of_all(ix, k)
    own = ix.points.select("block", "pid", "features")
    other = own.select("block", F.col("pid").alias("nbr"), F.col("features").alias("nf"))
    inner = (
        own.join(other, "block")
        .filter(F.col("pid") != F.col("nbr"))
        .select("pid", V.euclidean("features", "nf", ix.dim).alias("dist"), "nbr")
    )
    want = min(k, ix.n - 1)
    order = W.partitionBy("pid").orderBy("dist", "nbr")
    kth = (
        inner.withColumn("__r", F.row_number().over(order))
        .filter(F.col("__r") <= want)
        .groupBy("pid")
        .agg(F.max("dist").alias("radius"))
    )
    pts = cut(ix.points.join(kth, "pid"))
    ball = with_points(ix, pts, {"radius": ("max", F.col("radius"))})
    leaves, _ = walk_pairs(ball, ball, within(F.col("a_radius")))
    near = point_pairs(pts, pts, leaves, ix.dim, F.col("p_radius"), ["pid", "radius"], ["pid"])
    near = near.filter(F.col("p_pid") != F.col("q_pid")).select(
        F.col("p_pid").alias("pid"), F.col("q_pid").alias("nbr"), "dist"
    )
    return near.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= want).drop("__r")


def knn_index(points: DataFrame | BlockIndex, k: int) -> BlockIndex:
    """An index whose blocks are large enough for a search of ``k`` neighbours."""
    if isinstance(points, BlockIndex):
        if points.block_rows >= k + 1 or points.n <= points.block_rows:
            return points
        points = points.rows
    size = 32
    while size < 2 * (k + 1):
        size *= 2
    return block_index(points, size)


def knn_join(points: DataFrame | BlockIndex, k: int) -> DataFrame:
    """``(id, rank, nbr, dist)``: the ``k`` nearest other rows, ties to the smaller id.

    Copies of a row are neighbours at distance 0. No more than ``k + 1`` ids per location
    can matter, so locations are expanded to that many ids and ranked again.
    """
    flat = not isinstance(points, BlockIndex) and dim_of(points) > TREE_DIMS
    ix = flat_index(points) if flat else knn_index(points, k)
    near = location_knn(ix, k)
    if not ix.has_copies:
        order = W.partitionBy("id").orderBy("dist", "nbr")
        return near.withColumnRenamed("pid", "id").select("id", F.row_number().over(order).alias("rank"), "nbr", "dist")
    copies = cut(ix.copies())
    by_id = W.partitionBy("pid").orderBy("id")
    firsts = copies.withColumn("__r", F.row_number().over(by_id)).filter(F.col("__r") <= k + 1).drop("__r")
    here = ix.points.select("pid", F.col("pid").alias("nbr"), F.lit(0.0).alias("dist"))
    spread = (
        near.unionByName(here)
        .join(firsts.select(F.col("pid").alias("nbr"), F.col("id").alias("nbr_id")), "nbr")
        .select("pid", "nbr_id", "dist")
    )
    order = W.partitionBy("pid").orderBy("dist", "nbr_id")
    lists = (
        spread.withColumn("__r", F.row_number().over(order))
        .filter(F.col("__r") <= k + 1)
        .groupBy("pid")
        .agg(F.sort_array(F.collect_list(F.struct("__r", "nbr_id", "dist"))).alias("near"))
        .join(ix.points.select("pid", "w"), "pid")
    )
    rows = attach(copies, lists, "pid", "w")
    # a row of a large group of copies may not be among its location's first ids
    kept = F.slice(F.filter("near", lambda s: s["nbr_id"] != F.col("id")), 1, k)
    return rows.select("id", F.posexplode(kept).alias("pos", "s")).select(
        "id", (F.col("pos") + 1).alias("rank"), F.col("s.nbr_id").alias("nbr"), F.col("s.dist").alias("dist")
    )


def knn_edges(knn: DataFrame, mutual: bool = False) -> DataFrame:
    """Undirected neighbour edges ``(src, dst, dist)``, ``src < dst``; mutual keeps two-way ones."""
    one = knn.select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst"), "dist")
    grouped = one.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.count(F.lit(1)).alias("n"))
    return (grouped.filter(F.col("n") == 2) if mutual else grouped).select("src", "dst", "dist")


def knn_graph(points: DataFrame | BlockIndex, k: int, mutual: bool = False) -> DataFrame:
    """Neighbour graph ``(src, dst, dist, weight, similarity)``."""
    edges = knn_edges(knn_join(points, k), mutual)
    return edges.withColumn("weight", V.edge_weight("dist")).withColumn("similarity", V.edge_similarity("dist"))


def location_core_distance(ix: BlockIndex, min_pts: int, eps: float | None = None) -> DataFrame:
    """``(pid, core_dist)``: distance to the ``min_pts``-th row, itself first; NULL beyond ``eps``."""
    base = ix.points.select("pid", "w")
    if min_pts <= 1:
        return base.select("pid", F.lit(0.0).alias("core_dist"))
    near = location_knn(ix, min_pts - 1).join(
        ix.points.select(F.col("pid").alias("nbr"), F.col("w").alias("nbr_w")), "nbr"
    )
    run = W.partitionBy("pid").orderBy("dist", "nbr").rowsBetween(W.unboundedPreceding, 0)
    reached = (
        near.withColumn("__cum", F.sum("nbr_w").over(run))
        .join(base, "pid")
        .filter(F.col("__cum") + F.col("w") >= min_pts)
        .groupBy("pid")
        .agg(F.min("dist").alias("__d"))
    )
    core = F.when(F.col("w") >= min_pts, F.lit(0.0)).otherwise(F.col("__d"))
    if eps is not None:
        core = F.when(core <= F.lit(float(eps)), core)
    return base.join(reached, "pid", "left").select("pid", core.alias("core_dist"))


def core_distance(points: DataFrame | BlockIndex, min_pts: int, eps: float | None = None) -> DataFrame:
    """``(id, core_dist)`` for every row."""
    ix = knn_index(points, max(min_pts - 1, 1))
    return ix.spread(location_core_distance(ix, min_pts, eps))


def k_distance(points: DataFrame | BlockIndex, k: int) -> DataFrame:
    """The k-distance curve ``(rank, k_dist)``, ascending, the row itself counted as first.

    The position comes from a distributed sort, not from a one-task window.
    """
    from ..session import numbered

    curve, _, _ = numbered(core_distance(points, k), F.col("core_dist"), F.col("id"), name="rank")
    return curve.select("rank", "id", F.col("core_dist").alias("k_dist"))


@dataclass(frozen=True)
class PairsWithin:
    """The row pairs of ``points`` up to ``max_dist``, not listed yet."""

    points: DataFrame | BlockIndex
    max_dist: float

    def listed(self) -> DataFrame:
        """``(src, dst, dist)``, ``src < dst``."""
        return row_pairs(self.points, self.max_dist).filter(F.col("src") < F.col("dst"))

    def below(self, dist: float) -> PairsWithin:
        """Those of them that are closer than ``dist``."""
        return PairsWithin(self.points, min(self.max_dist, math.nextafter(float(dist), -math.inf)))

    def rows(self) -> DataFrame | None:
        """Each row that has an id, once; None where an id stands at several places."""
        ix = self.points if isinstance(self.points, BlockIndex) else None
        points = ix.rows if ix else self.points
        dim = ix.dim if ix else dim_of(points)
        rows = points.select("id", "features").filter(F.col("id").isNotNull()).distinct()
        return None if _repeats(rows) else with_dim(rows, dim)

    def index(self, k: int = 1) -> BlockIndex | None:
        """The places of the rows, for a search of ``k`` neighbours; None where there are none or an id stands at several."""
        rows = self.rows()
        return None if rows is None or rows.isEmpty() else knn_index(rows, k)

    def nearest(self) -> DataFrame | None:
        """``(id, nearest, dist)`` of every row that is in a pair, ties to the smaller id; None where an id stands at several places.

        The pair of a row at the least distance is its first neighbour, so a search ball replaces the list of pairs.
        """
        rows = self.rows()
        if rows is None:
            return None
        if rows.isEmpty():
            return rows.select("id", F.col("id").alias("nearest"), F.lit(0.0).alias("dist"))
        near = knn_join(rows, 1).filter(F.col("dist") <= F.lit(float(self.max_dist)))
        return near.select("id", F.col("nbr").alias("nearest"), "dist")


def pair_distances(points: DataFrame | BlockIndex, max_dist: float, listed: bool = True) -> DataFrame | PairsWithin:
    """The long form of a distance matrix of the rows up to ``max_dist``: ``(src, dst, dist)``, ``src < dst``.

    Rows at one place are pairs at distance 0. With ``listed`` false the pairs are handed on as ``PairsWithin``,
    for operators that need not see each of them.
    """
    pairs = PairsWithin(points, max_dist)
    return pairs.listed() if listed else pairs


def threshold_graph(points: DataFrame | BlockIndex, eps: float, listed: bool = True) -> DataFrame | PairsWithin:
    """Unweighted edges between rows closer than ``eps``; with ``listed`` false they are handed on as ``PairsWithin``."""
    pairs = pair_distances(points, eps, listed)
    if not listed:
        return pairs.below(eps)
    return pairs.filter(F.col("dist") < F.lit(float(eps))).select("src", "dst")


def near_in_metric(points: DataFrame | BlockIndex, tol: float) -> DataFrame:
    """Row pairs that agree within ``tol`` on every axis: ``(src, dst)``, ``src < dst``; rows at one place do.

    The tree test on boxes is done per axis, so no euclidean ball is needed.
    """
    ix = index_of(points)
    d, t = ix.dim, F.lit(float(tol) * (1.0 + 1e-12))
    meets = reduce(
        lambda x, y: x & y,
        [
            (F.col("b_lo")[i] - F.col("a_hi")[i] <= t) & (F.col("a_lo")[i] - F.col("b_hi")[i] <= t)
            for i in range(d)
        ],
    )
    leaves, _ = walk_pairs(ix, ix, meets)
    pts = _row_points(ix)
    p = pts.select("block", F.col("ids").alias("p"), F.col("features").alias("pf"))
    q = pts.select(F.col("block").alias("q_block"), F.col("ids").alias("q"), F.col("features").alias("qf"))
    pairs = (
        leaves.select("a_node", "b_node")
        .join(p, F.col("a_node") == F.col("block"))
        .join(q, F.col("b_node") == F.col("q_block"))
        .filter(V.chebyshev("pf", "qf", d) <= F.lit(float(tol)))
        .select("p", "q")
    )
    return _listed(pairs, p="src", q="dst").filter(F.col("src") < F.col("dst"))
