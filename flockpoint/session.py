"""Lineage cuts in the folder the cluster shares, and distributed row numbering."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by the session; a private one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="flockpoint-")
    sc.setCheckpointDir(shared)


def shared_path(spark: SparkSession) -> str:
    """A new folder name in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def _write(df: DataFrame) -> str:
    path = shared_path(df.sparkSession)
    df.write.option("maxRecordsPerFile", 0).parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and continue from it.

    The files outlive lost executors, are read by column, and tell the optimizer their
    true size, so the next round's join choices rest on facts.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write(df))


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """While it lasts, Spark hands ``rows`` rows at a time at most to Python: for rows that carry long lists."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def joins_by_part_of_key(spark: SparkSession):
    """While it lasts, a join needs no new shuffle where both sides are already partitioned alike by some of its keys."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def apart_in_unions(spark: SparkSession):
    """While it lasts, the parts of a union that are one partition each stay partitions of their own."""
    key = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread_over(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by ``keys`` into the session's partition number before heavy row-local work.

    Adaptive coalescing goes by bytes; a small table of pairs that is about to fan out
    would otherwise be worked on by one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def numbered(df: DataFrame, *order: Column, name: str = "rank", sums: dict[str, Column] | None = None):
    """Add a dense 0-based row number in the given order, without a one-task window.

    Range-sorts, writes one file per sorted partition, and shifts the position inside a
    file by the rows of the files before it. What reaches the driver is one row per file. Returns the frame, its row count and the asked sums.
    """
    path = _write(df.orderBy(*order))
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    done = df.sparkSession.read.schema(df.schema).parquet(path)
    sums = sums or {}
    stats = (
        done.groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
        .orderBy("part")
        .collect()
    )
    total, offsets = 0, []
    for row in stats:
        offsets += [total] * (row["part"] + 1 - len(offsets))
        total += row["n"]
    totals = {k: sum(row[k] for row in stats) for k in sums}
    shift = F.split(F.lit(",".join(map(str, offsets or [0]))), ",")[part].cast("bigint")
    return done.select("*", (F.col("_metadata.row_index") + shift).alias(name)), total, totals


def attach(
    big: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    hot_rows: int = 1_000_000,
    how: str = "inner",
    by: str | None = None,
) -> DataFrame:
    """Join ``big`` with a table that has one row per key and knows each key's row count.

    Every key with more than ``hot_rows`` rows is split: both sides get a salt, the table
    row is repeated once per salt. There are at most ``rows / hot_rows`` such keys, a million
    for 10^12 rows at the default; that bounds the broadcast list. The salt is a hash of column ``by``, else of all columns.
    """
    hot = (
        table.select(key, F.col(weight).alias("__w"))
        .filter(F.col("__w") > hot_rows)
        .select(key, F.ceil(F.col("__w") / F.lit(hot_rows)).cast("int").alias("__salts"))
    )
    hashed = F.xxhash64(*([by] if by else [c for c in big.columns if c != key]))
    left = big.join(F.broadcast(hot), key, "left").withColumn(
        "__salt",
        F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(hashed, F.col("__salts")).cast("int")),
    )
    right = table.join(F.broadcast(hot), key, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    )
    return left.drop("__salts").join(right.drop("__salts"), [key, "__salt"], how).drop("__salt")


def _hot_keys(df: DataFrame, key: str, rows: int, name: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter(F.col("__n") > rows).select(key, F.ceil(F.col("__n") / F.lit(rows)).cast("int").alias(name))


def split_join(left: DataFrame, right: DataFrame, key: str, rows: int = 1_000_000) -> DataFrame:
    """Inner join on a key that may be hot on both sides.

    A key with more than ``rows`` rows on a side is cut into chunks there, and the other
    side repeats its rows of that key once per chunk; every task sees a bounded piece of
    either side. There are at most ``size / rows`` such keys per side, which bounds the broadcast list.
    """
    hot = _hot_keys(left, key, rows, "__l").join(_hot_keys(right, key, rows, "__r"), key, "full")
    hot = F.broadcast(hot.select(key, F.coalesce("__l", F.lit(1)).alias("__l"), F.coalesce("__r", F.lit(1)).alias("__r")))

    def cut_up(df: DataFrame, own: str, other: str) -> DataFrame:
        chunk = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.coalesce(F.col(own), F.lit(1))).cast("int")
        out = df.join(hot, key, "left").withColumn(f"{own}s", chunk)
        return out.withColumn(
            f"{other}s", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        ).drop("__l", "__r")

    a, b = cut_up(left, "__l", "__r"), cut_up(right, "__r", "__l")
    return a.join(b, [key, "__ls", "__rs"]).drop("__ls", "__rs")
