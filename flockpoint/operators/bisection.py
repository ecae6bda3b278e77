"""Two-way splits of graph clusters, all clusters at once.

A slow mode of the random walk inside each cluster is found by repeated averaging over the
neighbours; the cluster is cut at the median, so the halves are of equal size and few
edges cross. All clusters share every pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach, cut, joins_by_part_of_key
from .graphs import label_edges

PASSES = 12
PASSES_PER_WRITE = 4
RANGES = 4  # ranges of vertices per shuffle partition


def bisect(labels: DataFrame, edges: DataFrame, start: DataFrame | None = None, passes: int = PASSES) -> DataFrame:
    """``(id, label, side)`` with side 0 or 1. ``start`` may give a first guess ``(id, x)``."""
    here = labels.select("id", "label")
    inner = label_edges(edges, here).filter(F.col("ci") == F.col("cj"))
    both = cut(
        inner.select("src", "dst", "weight").unionByName(
            inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        )
    )
    strength = both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("g"))
    guess = F.pmod(F.xxhash64("id"), F.lit(2001)) / F.lit(1000.0) - F.lit(1.0)
    rows = here.join(strength.hint("merge"), "id", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    if start is None:
        rows = rows.withColumn("x", guess)
    else:
        rows = rows.join(start.select("id", "x").hint("merge"), "id", "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    n = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(RANGES * n, "x", "id").withColumn("p", F.spark_partition_id()))
    # rows that share an id share a range
    rows = cut(rows.drop("p").join(rows.groupBy("id").agg(F.min("p").alias("p")).hint("merge"), "id"))
    # half a step of the walk, so that no mode can alternate: one row per edge and one per vertex
    stay = F.when(F.col("g") > 0, F.lit(0.5)).otherwise(F.lit(1.0))
    src = rows.select(F.col("id").alias("src"), F.col("p").alias("pi"), "g").hint("merge")
    dst = rows.select(F.col("id").alias("dst"), F.col("p").alias("pj")).distinct().hint("merge")
    moves = (
        both.join(src, "src").join(dst, "dst")
        .select("pi", F.col("src").alias("i"), "pj", F.col("dst").alias("j"), (F.col("weight") / (F.col("g") * 2)).alias("c"))
        .unionByName(rows.select(F.col("p").alias("pi"), F.col("id").alias("i"), F.col("p").alias("pj"), F.col("id").alias("j"), stay.alias("c")))
    )
    moves = moves.repartition(n, "pj").persist()
    # the walk keeps the weighted mean of every cluster, so it is taken out once
    mean = rows.groupBy("label").agg(
        F.sum(F.col("g") * F.col("x")).alias("gx"), F.sum("g").alias("gs"), F.count(F.lit(1)).alias("n")
    ).select("label", "n", F.when(F.col("gs") > 0, F.col("gx") / F.col("gs")).otherwise(F.lit(0.0)).alias("m"))
    state = attach(rows.select("id", "p", "label", "x"), mean, "label", "n").select("p", "id", (F.col("x") - F.col("m")).alias("x"))
    for i in range(passes):
        at = state.select(F.col("p").alias("pj"), F.col("id").alias("j"), "x").repartition(n, "pj")
        sums = moves.join(at.hint("shuffle_hash"), ["pj", "j"]).groupBy("pj", "pi", "i").agg(F.sum(F.col("c") * F.col("x")).alias("x"))
        state = sums.repartition(n, "pi").groupBy(F.col("pi").alias("p"), F.col("i").alias("id")).agg(F.sum("x").alias("x"))
        if (i + 1) % PASSES_PER_WRITE == 0 or i + 1 == passes:
            with joins_by_part_of_key(labels.sparkSession):
                state = cut(state)
    moves.unpersist()
    state = cut(state.select("id", "x").join(here.hint("merge"), "id"))
    middle = state.groupBy("label").agg(F.percentile_approx("x", 0.5, 100_000).alias("mid"), F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"))
    split = attach(state.select("id", "label", "x"), middle, "label", "n")
    # at least one row on the lower side: with the median at the bottom, only the ties there
    side = F.when(F.col("mid") > F.col("lo"), F.col("x") >= F.col("mid")).otherwise(F.col("x") > F.col("mid"))
    return split.select("id", "label", side.cast("int").alias("side"))


def bisection_stats(labels: DataFrame, edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``(label, size, cut_n, cut_w)``: the edges cut by splitting each cluster in two."""
    halves = cut(bisect(labels, edges, start))
    sizes = halves.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    a = halves.select(F.col("id").alias("src"), F.col("label").alias("la"), F.col("side").alias("sa"))
    b = halves.select(F.col("id").alias("dst"), F.col("label").alias("lb"), F.col("side").alias("sb"))
    crossing = (
        edges.select("src", "dst", "weight")
        .join(a.hint("merge"), "src")
        .join(b.hint("merge"), "dst")
        .filter((F.col("la") == F.col("lb")) & (F.col("sa") != F.col("sb")))
        .groupBy(F.col("la").alias("label"))
        .agg(F.count(F.lit(1)).alias("cut_n"), F.sum("weight").alias("cut_w"))
    )
    return sizes.join(crossing, "label", "left").select(
        "label", "size", F.coalesce("cut_n", F.lit(0)).alias("cut_n"), F.coalesce("cut_w", F.lit(0.0)).alias("cut_w")
    )


def partition_graph(vertices: DataFrame, edges: DataFrame, m: int, start: DataFrame | None = None) -> DataFrame:
    """``(id, label)`` with up to ``m`` parts, the largest part split first.

    The larger half takes the new label. Parts that would be split before any of their
    halves could be the largest are split in the same round.
    """
    labels = cut(vertices.select("id", F.lit(0).alias("label")))
    count = 1
    while count < m:
        sizes = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}  # at most m rows
        top = max(sizes.values())
        if top < 2:
            break
        todo = sorted((l for l, n in sizes.items() if n * 2 > top and n > 1), key=lambda l: (-sizes[l], l))[: m - count]
        chosen = labels.filter(F.col("label").isin(todo))
        halves = cut(bisect(chosen, edges, start))
        got = {(r["label"], r["side"]): r["count"] for r in halves.groupBy("label", "side").count().collect()}
        new, fresh = F.col("label"), count
        for l in todo:
            if (l, 0) in got and (l, 1) in got:
                larger = 0 if got[(l, 0)] >= got[(l, 1)] else 1
                new = F.when((F.col("label") == l) & (F.col("side") == larger), F.lit(fresh)).otherwise(new)
                fresh += 1
        if fresh == count:
            break
        split = halves.select("id", new.cast("int").alias("label"))
        labels = cut(labels.filter(~F.col("label").isin(todo)).unionByName(split))
        count = fresh
    return labels
