"""Mixing sources to target weights by weighted sampling with exponential keys.

Every row draws the key ``-ln(u) / quality`` from a uniform hash of its id; small keys come first, so better
documents are likelier to be early (Efraimidis and Spirakis). A source's budget first buys complete epochs
of the source; what is left is the fraction, bought in key order up to the budget by a prefix sum.

Sources are never one group: each is dealt into key ranges of about ``range_rows`` rows; range totals are summed
over the ranges of a source, rows only inside their range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, numbered


def word_count(text: Column) -> Column:
    """Runs of characters other than [\\x20\\x09-\\x0D]; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) from the md5 of the columns: the first 12 hex digits."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def plausible_words() -> Column:
    """Quality weight over ``text`` and ``size``: half for texts whose characters per word are unlike prose, or without words."""
    return F.when(F.try_divide(F.length("text"), F.col("size")).between(3, 11), 1.0).otherwise(0.5)


def source_targets(sizes: DataFrame, weights: Sequence[float], percent: int, most: float) -> DataFrame:
    """``(source, source_size, n_rows, target)`` from ``(source, source_size, n_rows)``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``percent`` of 100 of all sizes; no
    target exceeds ``most`` times its source's size, the excess goes to the others by weight until none is above.
    """
    sizes = cut(sizes)
    ranked, _, _ = numbered(sizes, F.col("source").asc_nulls_last(), name="__rank")
    weight = F.lit(list(map(float, weights)))[(F.col("__rank") % len(weights)).cast("int")]
    ranked = cut(ranked.withColumn("__w", weight))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    full = F.col("source_size") * F.lit(float(most))
    level, capped = None, -1
    while True:  # one more source at its limit each time, at least
        above = F.lit(False) if level is None else full <= F.col("__w") * F.lit(level)
        got = ranked.agg(
            F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("s"),
            F.sum(F.when(above, 0.0).otherwise(F.col("__w"))).alias("w"),
            F.sum(above.cast("int")).alias("n"),
        ).first()
        if (got["n"] or 0) == capped or not got["w"]:
            break
        capped, level = got["n"], (total * percent / 100 - got["s"] * float(most)) / got["w"]
    level = 0.0 if level is None else level
    return ranked.select("source", "source_size", "n_rows", F.least(full, F.col("__w") * F.lit(level)).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: Sequence[float] = (5, 2, 1),
    percent: int = 150,
    most: float = 2.0,
    whole: bool = False,
    range_rows: int = 10_000,
    seed: int = 1,
) -> DataFrame:
    """``(id_col, size, source_size, target, taken, tie)``, one row per row of ``docs``.

    ``size`` is the text's number of words, ``target`` its source's, ``taken`` the number of words that the mix takes of the
    row, repeats counted: its size for every complete epoch, and once more while the source's budget lasts. The
    row on which it ends gives its first words up to the budget; with ``whole`` it is taken or left, whichever comes
    nearer. ``tie`` is the crc32 of the text.

    ``quality`` is a positive weight over columns of ``docs`` and ``size``; null and other values count as 1. Null texts have size
    0, null sources are a source. Equal keys are ordered by id, text and size; rows that repeat in all of these are
    alike, so reruns agree. A source without words has target 0 and takes 0.
    """
    size = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).alias("__tie"),
        *(c for c in docs.columns if c != "size"),
        word_count(F.col(text_col)).alias("size"),
    )
    q = F.lit(1.0) if quality is None else F.coalesce(F.when(quality > 0, quality.cast("double")), F.lit(1.0))
    key = -F.log(uniform(F.col("__id"), F.lit(seed))) / q
    slim = cut(size.select("__id", "__source", "__tie", "size", key.alias("__key")))
    sizes = slim.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = cut(source_targets(sizes, weights, percent, most))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.select(
        F.col("source").alias("__s"),
        "source_size",
        "target",
        F.floor(share).alias("__epochs"),
        F.floor(F.col("target") - F.floor(share) * F.col("source_size")).alias("__rest"),
        F.ceil(F.col("n_rows") / range_rows).alias("__ranges"),
    )
    # exp(-key) lies in (0, 1); equal ranges of it follow the order of the key
    place = F.floor((1 - F.exp(-F.col("__key"))) * F.col("__ranges"))
    rows = slim.join(targets, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__range", place)
    sums = rows.groupBy("__source", "__range").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("__source").alias("__rs"), F.col("__range").alias("__rr"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")
    )
    rows = rows.join(sums, F.col("__source").eqNullSafe(F.col("__rs")) & (F.col("__range") == F.col("__rr")))
    inside = Window.partitionBy("__source", "__range").orderBy("__key", "__id", "__tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    if whole:
        part = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(0)
    else:
        part = F.greatest(F.lit(0), F.least("size", left))
    return rows.select(
        F.col("__id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("__epochs") * F.col("size") + part).cast("long").alias("taken"),
        F.col("__tie").alias("tie"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it: whole texts, rows not taken are gone.

    Rows without words follow no budget and stay once. Rows that repeat an id and text are taken alike.
    """
    taken = mix_sources(docs, id_col, text_col, whole=True, **how)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1)
    copies = taken.groupBy(F.col(id_col).alias("__id"), F.col("tie").alias("__tie")).agg(F.max(copies).cast("int").alias("__copies")).filter("__copies > 0")
    tie = F.coalesce(F.crc32(F.col(text_col)), F.lit(0))
    met = docs.join(copies, F.col(id_col).eqNullSafe(F.col("__id")) & (tie == F.col("__tie")))
    return met.withColumn("__n", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)
