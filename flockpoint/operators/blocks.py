"""Equal-sized blocks of nearby points and the box tree above them.

Copies of a location are folded into one weighted row first, so a group of copies,
however large, is one row here. The remaining locations are sorted along a bit-
interleaved curve and cut every ``block_rows`` rows: every block has the same number of
rows whatever the density, so no block, and no task that works on a block pair, grows
with a dense spot. Thirty-two neighbouring blocks share a parent node, and so on up to one
root. Pairs of nodes are walked down from the root by joins on the parent; pairs whose
boxes are too far apart are dropped at the highest possible level. The curve and the
block size change speed only, never results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import attach, cut, numbered, spread_over
from ..sources.points import dim_of, with_dim

FANOUT_BITS = 5
SLACK = 1e-9  # relative margin on box tests; the point test decides


@dataclass(frozen=True)
class BlockIndex:
    points: DataFrame  # pid, features, w, rank, block
    rows: DataFrame  # id, features (the caller's rows)
    nodes: list[DataFrame]  # per level: node, lo, hi, w, ...
    n: int  # locations
    n_rows: int
    dim: int
    block_rows: int

    @property
    def has_copies(self) -> bool:
        return self.n_rows > self.n

    def copies(self) -> DataFrame:
        """``(id, pid)``: which location each row of the caller belongs to."""
        if not self.has_copies:
            return self.rows.select("id", F.col("id").alias("pid"))
        key = F.xxhash64("features")
        table = self.points.select(F.struct(key.alias("h"), F.col("features").alias("f")).alias("loc"), "pid", "w")
        big = self.rows.select("id", F.struct(key.alias("h"), F.col("features").alias("f")).alias("loc"))
        return attach(big, table, "loc", "w").select("id", "pid")

    def spread(self, per_location: DataFrame) -> DataFrame:
        """Give every row of the caller its location's result (keyed by ``pid``)."""
        if not self.has_copies:
            return per_location.withColumnRenamed("pid", "id")
        weights = self.points.select("pid", F.col("w").alias("__w"))
        table = per_location.join(weights, "pid")
        return attach(self.copies(), table, "pid", "__w").drop("pid", "__w")


def locations(points: DataFrame) -> DataFrame:
    """Distinct locations with the smallest id there and the number of rows."""
    return points.groupBy("features").agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w"))


def curve_key(features: Column, lo: list[float], hi: list[float]) -> Column:
    """Interleaved bits of the scaled coordinates: near codes, near points."""
    dims = sorted(range(len(lo)), key=lambda i: lo[i] - hi[i])[: min(len(lo), 4)]
    bits = min(60 // max(len(dims), 1), 20)
    code = F.lit(0).cast("bigint")
    for j, i in enumerate(dims):
        width = (hi[i] - lo[i]) or 1.0
        q = F.floor((features[i] - F.lit(lo[i])) / F.lit(width) * F.lit(float((1 << bits) - 1))).cast("bigint")
        if len(dims) == 1:
            return q
        spread = reduce(
            lambda x, y: x.bitwiseOR(y),
            [
                F.shiftleft(F.shiftright(q, b).bitwiseAND(F.lit(1)), b * len(dims) + j)
                for b in range(bits)
            ],
        )
        code = code.bitwiseOR(spread)
    return code


def build_nodes(points: DataFrame, n_blocks: int, dim: int, extra: dict[str, tuple[str, Column]] | None = None):
    """Box tables per level, leaf blocks first. ``extra`` adds (sum|min|max, column) statistics."""
    extra = extra or {}
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    x = F.col("features")
    height, size = 0, n_blocks
    while size > 1:
        height, size = height + 1, ((size - 1) >> FANOUT_BITS) + 1
    leaf = points.groupBy(F.col("block").alias("node")).agg(
        V.per_dim(F.min, x, dim).alias("lo"),
        V.per_dim(F.max, x, dim).alias("hi"),
        F.sum("w").alias("w"),
        *[fold[how](c).alias(name) for name, (how, c) in extra.items()],
    )
    low, high, level = F.col("lo"), F.col("hi"), F.col("level")
    table = cut(
        leaf.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(height))))
        .groupBy("level", F.expr(f"shiftright(node, {FANOUT_BITS} * level)").alias("node"))
        .agg(
            V.per_dim(F.min, low, dim).alias("lo"),
            V.per_dim(F.max, high, dim).alias("hi"),
            F.sum("w").alias("w"),
            *[fold[how](name).alias(name) for name, (how, _) in extra.items()],
        )
    )
    return [table.filter(level == i).drop("level") for i in range(height + 1)]


def block_index(points: DataFrame, block_rows: int | None = None) -> BlockIndex:
    """Fold copies, sort along the curve, cut into blocks, build the box tree."""
    dim = dim_of(points)
    x = F.col("features")
    base = locations(points)
    box = points.agg(*[F.min(x[i]) for i in range(dim)], *[F.max(x[i]) for i in range(dim)], F.count(F.lit(1))).first()
    if not box[-1]:
        raise ValueError("the point table is empty")
    lo, hi, total_rows = list(box)[:dim], list(box)[dim : 2 * dim], box[-1]
    if block_rows is None:
        block_rows = 32 if total_rows < 10_000_000 else 256
    coded = base.select("pid", "features", "w", curve_key(x, lo, hi).alias("__code"))
    ranked, n, sums = numbered(coded, F.col("__code"), F.col("features"), sums={"w": F.col("w")})
    n_blocks = max(n // block_rows, 1)
    block = F.least(F.floor(F.col("rank") / F.lit(block_rows)), F.lit(n_blocks - 1)).cast("bigint")
    pts = with_dim(ranked.select("pid", "features", "w", "rank", block.alias("block")), dim)
    nodes = build_nodes(pts, n_blocks, dim)
    return BlockIndex(pts, points.select("id", "features"), nodes, n, int(sums["w"]), dim, block_rows)


def flat_index(points: DataFrame) -> BlockIndex:
    """Locations in order of their smallest ids, without boxes: for searches that meet every location."""
    dim = dim_of(points)
    ranked, n, sums = numbered(locations(points), F.col("pid"), F.col("features"), sums={"w": F.col("w")})
    if not n:
        raise ValueError("the point table is empty")
    pts = with_dim(ranked.select("pid", "features", "w", "rank", F.lit(0).cast("bigint").alias("block")), dim)
    return BlockIndex(pts, points.select("id", "features"), [], n, int(sums["w"]), dim, n)


def n_blocks(index: BlockIndex) -> int:
    return max(index.n // index.block_rows, 1)


def with_points(index: BlockIndex, points: DataFrame, extra: dict[str, tuple[str, Column]]) -> BlockIndex:
    """The same blocks with more columns on the points and folded statistics on the nodes."""
    return replace(index, points=points, nodes=build_nodes(points, n_blocks(index), index.dim, extra))


def _side(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{tag}_{c}") for c in nodes.columns])


def walk_pairs(left: BlockIndex, right: BlockIndex, keep: Column, stop: Column | None = None):
    """Walk node pairs down to the leaf blocks.

    ``keep`` drops pairs, ``stop`` marks pairs that are settled at their level. Both may
    use ``a_*``, ``b_*``, ``gap2`` and ``span2``. Returns the leaf pairs that are kept and
    not stopped, and the settled pairs ``(level, a_node, b_node, b_w)`` for trees of equal depth.
    """
    dim = left.dim
    la, lb = len(left.nodes) - 1, len(right.nodes) - 1
    a, b = _side(left.nodes[la], "a"), _side(right.nodes[lb], "b")
    pairs = a.join(b, F.col("a_node") == F.col("b_node"))
    gap = V.box_gap2("a_lo", "a_hi", "b_lo", "b_hi", dim).alias("gap2")
    span = V.box_span2("a_lo", "a_hi", "b_lo", "b_hi", dim).alias("span2")
    measure = [gap] + ([span] if stop is not None else [])
    settled = []

    def judge(frame: DataFrame) -> DataFrame:
        return frame.select("*", *measure).filter(keep)

    def drop(frame: DataFrame, tag: str) -> DataFrame:
        gone = [c for c in frame.columns if c.startswith(f"{tag}_") and c != f"{tag}_node"]
        return frame.drop(*gone, "gap2", "span2").withColumnRenamed(f"{tag}_node", f"{tag}_up")

    pairs = judge(pairs)
    while True:
        if stop is not None:
            settled.append(pairs.filter(stop).select(F.lit(la).alias("level"), "a_node", "b_node", "b_w"))
            pairs = pairs.filter(~stop)
        if la == 0 and lb == 0:
            return spread_over(pairs, "a_node"), reduce(DataFrame.unionByName, settled) if settled else None
        if la > 0:
            la -= 1
            down = _side(left.nodes[la], "a").withColumn("__p", F.shiftright("a_node", FANOUT_BITS))
            pairs = drop(pairs, "a").join(down, F.col("a_up") == F.col("__p")).drop("a_up", "__p")
            pairs = judge(pairs) if stop is None else pairs
        if lb > 0:
            lb -= 1
            down = _side(right.nodes[lb], "b").withColumn("__p", F.shiftright("b_node", FANOUT_BITS))
            pairs = drop(pairs, "b").join(down, F.col("b_up") == F.col("__p")).drop("b_up", "__p")
            pairs = judge(pairs)


def within(radius: float | Column) -> Column:
    """Keep test: boxes no further apart than ``radius``."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    return F.col("gap2") <= r * r * F.lit(1.0 + SLACK)


def inside(radius: float | Column) -> Column:
    """Settled test: every point of one box within ``radius`` of every point of the other."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    return F.col("span2") <= r * r * F.lit(1.0 - SLACK)


def point_pairs(
    left_points: DataFrame,
    right_points: DataFrame,
    leaves: DataFrame,
    dim: int,
    radius: float | Column,
    left_cols: list[str],
    right_cols: list[str],
) -> DataFrame:
    """Point pairs of the leaf pairs with distance at most ``radius`` (may use ``p_*``).

    Each left point meets a right block only when its ball reaches the block's box.
    Columns come out as ``p_*`` and ``q_*`` with ``dist``.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    p = left_points.select(
        F.col("block").alias("p_block"), F.col("features").alias("p_features"), *[F.col(c).alias(f"p_{c}") for c in left_cols]
    )
    q = right_points.select(
        F.col("block").alias("q_block"), F.col("features").alias("q_features"), *[F.col(c).alias(f"q_{c}") for c in right_cols]
    )
    boxes = leaves.select("a_node", "b_node", F.col("b_lo").alias("__lo"), F.col("b_hi").alias("__hi"))
    gap = V.box_gap2("p_features", "p_features", "__lo", "__hi", dim)
    reach = (
        p.join(boxes, F.col("p_block") == F.col("a_node"))
        .filter(gap <= r * r * F.lit(1.0 + SLACK))
        .drop("a_node", "__lo", "__hi")
    )
    dist = V.euclidean("p_features", "q_features", dim)
    return (
        spread_over(reach, "b_node")
        .join(q, F.col("b_node") == F.col("q_block"))
        .withColumn("dist", dist)
        .filter(F.col("dist") <= r)
        .drop("b_node", "p_block", "q_block")
    )
