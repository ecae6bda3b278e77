"""Clustering features on cells, their centroids joined, points to the nearest centroid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assign import assign_nearest
from ..operators.features import absorb, grow_threshold, leaf_entries
from ..operators.forest import cut_forest, reach_forest
from ..operators.neighbours import knn_index, location_knn
from ..session import cut
from ..sources.points import dim_of, with_dim


def birch(
    points: DataFrame, k: int, diameter: float = 0.5, growth: float = 1.5, max_entries: int = 500, merge_cells: bool = False
):
    """``(labels, entries)``: ``(id, label, entry, dist)`` and the feature entries.

    The diameter grows until at most ``max_entries`` cells remain; the centroids of the
    entries are cut into ``k`` single-linkage clusters; each row goes to its nearest entry.
    """
    cfs, reached = grow_threshold(points, diameter, growth, max_entries)
    if merge_cells:
        cfs = absorb(cfs, reached)
    entries = cut(leaf_entries(cfs))
    centres = with_dim(entries.select(F.col("entry").alias("id"), F.col("centroid").alias("features")), dim_of(points))
    ix = knn_index(centres, 8)
    zero = ix.points.select("pid", F.lit(0.0).alias("core_dist"))
    forest = cut(reach_forest(ix, zero, cut(location_knn(ix, 8))))
    parts = cut_forest(ix.points.select(F.col("pid").alias("id")), forest, k=k)
    heads = parts.select("component").distinct()
    from ..session import numbered

    order, _, _ = numbered(heads, F.col("component"), name="label")
    named = parts.join(order, "component").select(F.col("id").alias("entry"), F.col("label").cast("int").alias("label"))
    near = assign_nearest(points, centres.select(F.col("id").alias("center"), "features"))
    # at most max_entries rows
    labels = near.select("id", F.col("center").alias("entry"), "dist").join(F.broadcast(named), "entry").select("id", "label", "entry", "dist")
    return labels, entries.join(named, "entry")
