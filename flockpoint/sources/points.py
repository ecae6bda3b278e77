"""Point tables: construction, samples, splits and label clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import numbered


def dim_of(points: DataFrame, col: str = "features") -> int:
    """The dimension, from column metadata when known, else from one row."""
    known = points.schema[col].metadata.get("dim")
    if known:
        return int(known)
    row = points.select(F.size(col).alias("d")).first()
    if row is None:
        raise ValueError("the point table is empty")
    return int(row["d"])


def with_dim(points: DataFrame, dim: int, col: str = "features") -> DataFrame:
    return points.withMetadata(col, {"dim": int(dim)})


def as_points(
    df: DataFrame,
    id: str | Column,
    cols: str | list[str | Column],
    on_null: str = "error",
    scale: str | None = None,
) -> DataFrame:
    """``(id BIGINT, features ARRAY<DOUBLE>)`` from number columns or one array column.

    ``on_null`` is ``error`` or ``drop`` for missing or NaN coordinates; ``scale`` is
    ``minmax`` or ``standard``.
    """
    if on_null not in ("error", "drop"):
        raise ValueError("on_null is 'error' or 'drop'")
    ident = (F.col(id) if isinstance(id, str) else id).cast("bigint")
    if isinstance(cols, str):
        raw = df.select(ident.alias("id"), F.col(cols).cast("array<double>").alias("features"))
        dim = dim_of(raw)
    else:
        parts = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in cols]
        raw = df.select(ident.alias("id"), F.array(*parts).alias("features"))
        dim = len(parts)
    bad = (
        F.col("id").isNull()
        | F.col("features").isNull()
        | (F.size("features") != dim)
        | F.exists("features", lambda v: v.isNull() | F.isnan(v))
    )
    if on_null == "drop":
        out = raw.filter(~F.coalesce(bad, F.lit(True)))
    else:
        message = F.lit("missing, NaN or ragged coordinates in the point table")
        out = raw.withColumn("features", F.when(~bad, F.col("features")).otherwise(F.raise_error(message)))
    if scale is not None:
        out = _scaled(out, dim, scale)
    return with_dim(out, dim)


def _scaled(points: DataFrame, dim: int, how: str) -> DataFrame:
    x = F.col("features")
    if how == "minmax":
        aggs = [F.min(x[i]) for i in range(dim)] + [F.max(x[i]) - F.min(x[i]) for i in range(dim)]
    elif how == "standard":
        aggs = [F.avg(x[i]) for i in range(dim)] + [F.stddev_pop(x[i]) for i in range(dim)]
    else:
        raise ValueError("scale is 'minmax' or 'standard'")
    row = points.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)]).first()
    shift, width = list(row)[:dim], list(row)[dim:]
    terms = [
        (x[i] - F.lit(float(shift[i] or 0.0))) / F.lit(float(width[i]) if width[i] else 1.0) for i in range(dim)
    ]
    return points.withColumn("features", F.array(*terms))


def read_points(spark: SparkSession, path: str, id: str, cols, fmt: str = "parquet", **kw) -> DataFrame:
    """Points straight from files; only the named columns are read."""
    return as_points(spark.read.format(fmt).load(path), id, cols, **kw)


def write_labels(labels: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    labels.write.mode(mode).format(fmt).save(path)


def as_points_sparse(df: DataFrame, id: str, dim: str, value: str) -> DataFrame:
    """``(id, features MAP<INT, DOUBLE>)`` from one row per non-zero coordinate; doubles add up."""
    cells = df.groupBy(F.col(id).cast("bigint").alias("id"), F.col(dim).cast("int").alias("d")).agg(
        F.sum(F.col(value).cast("double")).alias("v")
    )
    return cells.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("d", "v")))).alias("features"))


def densify(sparse: DataFrame, dim: int) -> DataFrame:
    """Sparse rows as dense points; absent coordinates are 0."""
    cells = [F.coalesce(F.col("features")[i], F.lit(0.0)) for i in range(dim)]
    return with_dim(sparse.select("id", F.array(*cells).alias("features")), dim)


def singletons(points: DataFrame) -> DataFrame:
    """Every row its own cluster."""
    return points.select(F.col("id").alias("cluster_id"), F.col("id").alias("point_id"))


def sample_key(seed: int, *more: Column) -> Column:
    """A repeatable pseudo-random order for rows with an ``id``."""
    return F.xxhash64(F.col("id"), F.lit(int(seed)), *more)


def sample_n(points: DataFrame, n: int, seed: int = 42, top_rows: int = 10_000) -> DataFrame:
    """``n`` rows drawn without replacement; the same rows for the same seed.

    Up to ``top_rows`` come from the tasks' tops; more are numbered by a distributed sort. Either
    way these are the first ``n`` by hash.
    """
    if n <= top_rows:
        return points.orderBy(sample_key(seed), F.col("id")).limit(n)
    from ..session import numbered

    rows, _, _ = numbered(points, sample_key(seed), F.col("id"), name="__pos")
    return with_dim(rows.filter(F.col("__pos") < n).drop("__pos"), dim_of(points))


def sample_share(points: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Rows whose hash falls into the given share: one scan, no sort."""
    unit = F.pmod(sample_key(seed), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return points.filter(unit < F.lit(float(share)))


def sample_per_run(points: DataFrame, k: int, runs: int, seed: int = 42) -> DataFrame:
    """``k`` distinct rows for each run as ``(run, id, features)``.

    Each run is a small sorted pick over its own hash order, done from the task-local
    tops, so no row is copied once per run and nothing is shuffled but the tops.
    """
    out = None
    for run in range(runs):
        pick = sample_n(points, k, seed + 7919 * run).select(F.lit(run).alias("run"), "id", "features")
        out = pick if out is None else out.unionByName(pick)
    return out


def split_parts(points: DataFrame, parts: int, seed: int = 42) -> DataFrame:
    """Equal parts of the rows in hash order, numbered from 0."""
    ranked, total, _ = numbered(points, sample_key(seed), F.col("id"), name="__pos")
    part = F.floor(F.col("__pos") * F.lit(parts) / F.lit(max(total, 1))).cast("int")
    return ranked.withColumn("part", part).drop("__pos")


def rebuild_labels(labels: DataFrame, label: str = "label", start: int = 1) -> DataFrame:
    """Labels renumbered from ``start`` by the smallest id they hold; -1 stays noise.

    The numbering is done on the table of labels; it goes back to the rows by a join
    whose hot labels are split.
    """
    from ..session import attach

    firsts = (
        labels.filter(F.col(label) >= 0)
        .groupBy(F.col(label).alias("__old"))
        .agg(F.min("id").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    )
    order, _, _ = numbered(firsts, F.col("__first"), name="__new")
    table = order.select("__old", "__new", "__rows")
    rows = labels.withColumnRenamed(label, "__old")
    return (
        attach(rows, table, "__old", "__rows", how="left")
        .withColumn(label, F.coalesce((F.col("__new") + start).cast("int"), F.lit(-1)))
        .drop("__old", "__new", "__rows")
    )
