"""Site-relative line dedup with DataFrame functions only.

A line's boilerplate ratio on a host is the number of the host's pages that contain it over all pages of
the host; every line over the ratio goes, wherever it stands. What is a page: pages with the same text count once, and pages
that share the two lines with the smallest hashes count once in the ratio. So copies and most near copies of a page are one page,
whose lines are left to document dedup, while pages that only share a menu or a footer rarely agree in both of those lines.

Only line hashes are shuffled, folded per host before. A host's boilerplate list has at most
``mean lines per page / max_ratio`` entries, so it travels as one array per host; texts are not shuffled
as long as Spark can broadcast the hosts, else hot hosts are split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Lines without a character other than these are blank: never counted, never dropped.
BLANK = " \t\x0b\x0c\r"


def _filled(line):
    return F.length(F.btrim(line, F.lit(BLANK))) > 0


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float) -> DataFrame:
    """``(host, lines)``: per host the hashes of its boilerplate lines."""
    filled = F.array_distinct(F.filter(F.split(text, "\n"), _filled))
    distinct = (
        pages.filter(F.col(text).isNotNull())
        .select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), F.octet_length(text).alias("size"), filled.alias("filled"))
        .select(
            "host",
            "page",
            "size",
            F.transform("filled", lambda x: F.xxhash64(x)).alias("lines"),
            F.xxhash64(F.slice(F.array_sort(F.transform("filled", lambda x: F.md5(x))), 1, 2)).alias("kind"),
        )
        .groupBy("host", "page", "size")
        .agg(F.first(F.struct("lines", "kind")).alias("p"))
    )
    distinct = cut(distinct.select("host", "p.lines", "p.kind"))
    totals = cut(distinct.groupBy("host", "kind").agg(F.lit(1)).groupBy("host").agg(F.count(F.lit(1)).alias("kinds")))
    counts = distinct.select("host", "kind", F.explode("lines").alias("line")).groupBy("host", "line", "kind").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy(F.col("host").alias("h"), "line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("on"))
    frequent = counts.filter(F.col("n") >= 2)
    over = totals.join(frequent, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("on") > max_ratio * F.col("kinds"))
    return over.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.1) -> DataFrame:
    """``pages`` with ``text_col`` cleaned, and ``n_lines``, ``n_dropped`` added (overwriting columns of these names).

    Lines end at newlines. A line goes where it is on more than ``max_ratio`` of its host's pages and on two different texts at
    least; every occurrence goes, also where nothing else is left. Blank lines stay. A null text stays null with ``n_lines`` 0; an empty
    text is one blank line. Rows without a host form a host of their own. Repeated rows are cleaned alike. Other columns keep
    their names and values.
    """
    # kept as a written table: its true size decides how it meets the pages
    hosts = cut(boilerplate(pages, host_col, text_col, max_ratio)).select(F.col("host"), F.col("lines").alias("boiler"))
    kept = [c for c in pages.columns if c not in (text_col, "n_lines", "n_dropped")]
    own = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(text_col).alias("t"), F.col(host_col).alias("h"))
    rows = own.join(hosts, F.col("h").eqNullSafe(F.col("host")), "left")
    lines = F.split("t", "\n")
    left = F.filter(lines, lambda x: ~(_filled(x) & F.array_contains(F.col("boiler"), F.xxhash64(x))))
    rows = rows.withColumn("left", F.when(F.col("boiler").isNotNull(), left))
    n_lines = F.when(F.col("t").isNull(), 0).otherwise(F.size(lines))
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
        F.when(F.col("left").isNotNull(), F.array_join("left", "\n")).otherwise(F.col("t")).alias(text_col),
        n_lines.cast("int").alias("n_lines"),
        F.when(F.col("left").isNotNull(), n_lines - F.size("left")).otherwise(0).cast("int").alias("n_dropped"),
    )
