"""Streams of points: clustering features per window, and labels from a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.assign import assign_nearest


def windowed_features(
    stream: DataFrame, ts: str, cols: list[str], side: float, window: str, slide: str | None = None, watermark: str = "10 minutes"
) -> DataFrame:
    """``(window_start, window_end, cell, n, ls, ss)`` per window and cell.

    Works the same on a stream and on a table; on a stream, rows later than the watermark
    are left out and a window is emitted once it has passed.
    """
    dim = len(cols)
    when = F.col(ts)
    if stream.schema[ts].dataType.typeName() == "timestamp_ntz":
        # times without a zone are read as UTC, whatever the session's zone
        when = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), when))
    rows = stream.select(when.alias("ts"), F.array(*[F.col(c).cast("double") for c in cols]).alias("features"))
    rows = rows.withColumn("cell", V.cell_of("features", [0.0] * dim, side))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", watermark)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        rows.groupBy(span.alias("w"), "cell")
        .agg(
            F.count(F.lit(1)).alias("n"),
            V.per_dim(F.sum, "features", dim).alias("ls"),
            F.sum(V.dot("features", "features", dim)).alias("ss"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cell", "n", "ls", "ss")
    )


def stream_assign(stream: DataFrame, centers: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Label arriving points ``(id, features)`` with their nearest centre; needs no state."""
    return assign_nearest(stream, centers, metric).select("id", "center", "dist")
