"""Connected components and pointer compression, by contraction rounds.

Each round hooks every vertex to its smallest neighbour, follows the hooks to their
roots, and rewrites the edges on the roots; self edges and doubles vanish, so the edge
table shrinks geometrically. Hot vertices only meet partial aggregates and joins against
a table with one row per vertex, which adaptive execution splits. Once at most ``FINISH`` rows are left, one task
finishes them: a written table tells its row count, so that is checked, and the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach, cut
from .neighbours import PairsWithin

FINISH = 200_000  # rows of integers that one task finishes
HOPS = 3  # pointer hops per written round; each round's pointers are the next round's hops


def in_one_task(df: DataFrame, fold, schema: str, limit: int | None = None) -> DataFrame | None:
    """``fold`` of the columns of a written table (numpy arrays in, arrays out) in one task; None beyond ``limit`` rows.

    ``FINISH`` is the limit unless one is given. Columns must be integers or doubles.
    """
    limit = FINISH if limit is None else limit
    if any(kind not in ("bigint", "int", "double") for _, kind in df.dtypes) or df.count() > limit:
        return None
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        batches = list(batches)
        if batches:
            table = pa.Table.from_batches(batches)
            out = fold(*[c.to_numpy() for c in table.columns])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    return df.coalesce(1).mapInArrow(run, schema)


def _follow(up: np.ndarray) -> np.ndarray:
    while True:
        on = up[up]
        if np.array_equal(on, up):
            return up
        up = on


def _roots(ids: np.ndarray, parent: np.ndarray):
    order = np.argsort(ids)
    return ids, ids[order][_follow(np.searchsorted(ids[order], parent)[order])][np.argsort(order)]


def _lowest(src: np.ndarray, dst: np.ndarray):
    """Each id and the smallest id that it is linked with."""
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    u, v = ends[: len(src)], ends[len(src) :]
    up = np.arange(len(ids))
    while True:
        a, b = up[u], up[v]
        open_ = a != b
        if not open_.any():
            return ids, ids[up]
        np.minimum.at(up, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        up = _follow(up)


def compress(parents: DataFrame) -> DataFrame:
    """``(id, parent)`` -> ``(id, root)``; roots point to themselves, pointers have no cycles."""
    base = cut(parents.select("id", F.col("parent").alias("root")))
    kind = base.schema["id"].dataType.simpleString()
    done = in_one_task(base, _roots, f"id {kind}, root {kind}")
    if done is not None:
        return cut(done)
    while True:
        cur = base
        for i in range(HOPS):
            up = base.select(F.col("id").alias("__id"), F.col("root").alias("__up"))
            last = [(F.col("root") != F.col("__up")).alias("__open")] if i + 1 == HOPS else []
            cur = cur.join(up, F.col("root") == F.col("__id")).select("id", F.col("__up").alias("root"), *last)
        cur = cut(cur)
        # a row whose last hop moved nothing has reached its root
        if cur.filter("__open").isEmpty():
            return cur.drop("__open")
        base = cur.drop("__open")


def relabel(edges: DataFrame, roots: DataFrame, *cols: str) -> DataFrame:
    """Replace endpoint columns by their root where they have one."""
    for c in cols:
        table = roots.select(F.col("id").alias("__id"), F.col("root").alias("__root"))
        edges = (
            edges.join(table, F.col(c) == F.col("__id"), "left")
            .withColumn(c, F.coalesce("__root", c))
            .drop("__id", "__root")
        )
    return edges


def _components_within(vertices: DataFrame, pairs: PairsWithin) -> DataFrame:
    """The components of a graph by radius, from its places: blocks within the radius are linked as blocks."""
    from ..plans.dbscan import core_components

    ix = pairs.index()
    if ix is None:
        return connected_components(vertices, pairs.listed())
    every = ix.points.select("pid", F.lit(True).alias("is_core"))
    at = cut(core_components(ix, every, pairs.max_dist).select("pid", "component"))
    names = cut(at.groupBy("component").agg(F.min("pid").alias("root"), F.count(F.lit(1)).alias("places")))
    labels = ix.spread(attach(at, names, "component", "places", by="pid").select("pid", "root"))
    return vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def connected_components(vertices: DataFrame, edges: DataFrame | PairsWithin) -> DataFrame:
    """``(id, component)`` with the smallest id of each component as its name.

    ``vertices`` has ``id``; ``edges`` has ``src`` and ``dst`` in any direction, or is a graph by radius whose edges are not listed.
    """
    if isinstance(edges, PairsWithin):
        return _components_within(vertices, edges)
    pairs = (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )
    pairs = cut(pairs)
    labels = None
    while not pairs.isEmpty():
        last = in_one_task(pairs, _lowest, "id bigint, root bigint")
        if last is not None:
            last = cut(last)
            labels = last if labels is None else cut(relabel(labels, last, "root"))
            break
        both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
        roots = compress(hooks.select("id", F.least("id", "m").alias("parent")))
        if labels is None:
            labels = roots
        else:
            labels = cut(relabel(labels, roots, "root"))
        pairs = relabel(pairs, roots, "src", "dst").filter(F.col("src") != F.col("dst"))
        pairs = cut(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    ids = vertices.select("id")
    if labels is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def component_count(vertices: DataFrame, edges: DataFrame | PairsWithin) -> DataFrame:
    """One row ``(n_components)``: also the number of zero eigenvalues of the Laplacian."""
    comps = connected_components(vertices, edges)
    return comps.filter(F.col("id") == F.col("component")).agg(F.count(F.lit(1)).alias("n_components"))


def split_by_components(labels: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """Break every cluster into its connected pieces: ``(id, label)``.

    The piece with the smallest id keeps the label, the other pieces are numbered after
    the largest label in the order of (label, smallest id).
    """
    from ..session import numbered

    here = labels.select("id", F.col(label).alias("label"))
    inside = (
        edges.select("src", "dst")
        .join(here.select(F.col("id").alias("src"), F.col("label").alias("__a")), "src")
        .join(here.select(F.col("id").alias("dst"), F.col("label").alias("__b")), "dst")
        .filter(F.col("__a") == F.col("__b"))
        .select("src", "dst")
    )
    comps = cut(here.join(connected_components(here, inside), "id"))
    pieces = comps.groupBy("component").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("rows"))
    keep = pieces.groupBy("label").agg(F.min("component").alias("first"))
    joined = cut(pieces.join(keep, "label"))
    top = joined.agg(F.max("label")).first()[0]
    extra, _, _ = numbered(
        joined.filter(F.col("component") != F.col("first")), F.col("label"), F.col("component"), name="pos"
    )
    table = (
        joined.filter(F.col("component") == F.col("first"))
        .select("component", F.col("label").cast("int").alias("new"), "rows")
        .unionByName(extra.select("component", (F.col("pos") + F.lit(int(top) + 1)).cast("int").alias("new"), "rows"))
    )
    return attach(comps.select("id", "component"), table, "component", "rows").select("id", F.col("new").alias(label))
