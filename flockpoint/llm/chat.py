"""Chat formatting from reply trees.

Messages form trees by their parents. Iterated self-joins with doubling steps give every message its depth and the
score of its path; the best leaves of each tree are chosen, and their paths are unrolled by the same doubling
joins. Each chosen path becomes one conversation in a template of two marks:

    ### role: text</turn>

with a newline after each turn. Inside roles and texts ``#`` is written ``\\h``, ``<`` is ``\\l`` and the backslash
``\\b`` (in roles also the colon, ``\\c``), so no text can hold a mark and reading back gives the very same turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, numbered

OPEN, END = "### ", "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    """Reversible; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, mark in [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")] + [(":", "\\c")] * role:
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return out


def unescaped(text: str) -> str:
    return text.replace("\\c", ":").replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\")


def turns_of(formatted: str) -> list[tuple[str, str, int, int]]:
    """Read a conversation back: role, text, and the code points from and to which the text stands, per turn."""
    out, at = [], 0
    for turn in formatted.split(END)[:-1]:
        role, text = turn.removeprefix(OPEN).split(": ", 1)
        begin = at + len(turn) - len(text)
        out.append((unescaped(role), unescaped(text), begin, begin + len(text)))
        at += len(turn) + len(END)
    return out


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Root-to-leaf paths of the best ``branches`` leaves of each tree: ``(tree, leaf, rank, id, depth)``.

    ``nodes`` has ``tree, id, parent, score``; ids are distinct over all trees (see ``first_messages``), a parent that is null or not
    there makes a root. Where parents form a cycle, its smallest id is a root. A leaf's rank is by the sum of the scores on its
    path, ties by the smaller id; null scores count 0.
    """
    known = nodes.select(F.col("id").alias("parent"))
    base = nodes.join(known, "parent", "left_semi").select("id", F.col("parent").alias("up"))
    base = nodes.select("tree", "id", F.coalesce("score", F.lit(0.0)).alias("score")).join(base, "id", "left")
    # up: the ancestor 2^k above; score and steps of the path that ends just below it. A row whose path has
    # reached its root is done and only looked up from then on, so a round makes as many rows as are open.
    level = cut(base.select("tree", "id", "up", "score", F.lit(1).alias("steps")))
    parents = level.select(F.col("up").alias("id")).filter("id is not null").distinct()
    done = level.filter(F.col("up").isNull())
    jumps = [level.filter(F.col("up").isNotNull())]
    n = level.count()
    while not jumps[-1].isEmpty():
        if 1 << (len(jumps) - 1) >= n:
            # no path is that long, so what is open ends in cycles, and the ancestors so far up are the rows of the cycles
            rows = jumps[-1].select(F.col("up").alias("id")).distinct()
            around = jumps[0].join(rows, "id").select(F.col("id").alias("src"), F.col("up").alias("dst"))
            cycles = cut(connected_components(rows, around))
            roots = cycles.select(F.col("component").alias("id")).distinct().withColumn("root", F.lit(True))
            freed = nodes.join(roots, "id", "left").withColumn("parent", F.when(F.col("root").isNull(), F.col("parent")))
            return paths(cut(freed.select("tree", "id", "parent", "score")), branches)
        above = done.unionByName(jumps[-1]).select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("score").alias("__score"), F.col("steps").alias("__steps"))
        level = cut(
            jumps[-1].join(above, "up").select(
                "tree", "id", F.col("__up").alias("up"), (F.col("score") + F.col("__score")).alias("score"), (F.col("steps") + F.col("__steps")).alias("steps")
            )
        )
        done = done.unionByName(level.filter(F.col("up").isNull()))
        jumps.append(level.filter(F.col("up").isNotNull()))
    leaves = done.join(parents, "id", "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("id"))
    leaves = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    found = cut(leaves.select("tree", F.col("id").alias("leaf"), "rank", "id", F.col("steps").alias("depth")))
    for k in range(len(jumps) - 2, -1, -1):  # from the longest step down, every ancestor is met once
        step = jumps[k].select("id", "up")
        more = found.join(step, "id").select("tree", "leaf", "rank", F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth"))
        found = cut(found.unionByName(more))
    return found


def first_messages(nodes: DataFrame) -> DataFrame:
    """``nodes`` with each id once: of rows that repeat it, the smallest by tree, parent, role, text and score (null first)."""
    cols = ["tree", "parent", "role", "text", "score"]
    return nodes.groupBy("id").agg(F.min(F.struct(*cols)).alias("m")).select("id", *[F.col(f"m.{c}").alias(c) for c in cols])


def format_trees(nodes: DataFrame, branches: int = 1, loss_role: str = "assistant", distinct_ids: bool = False) -> DataFrame:
    """``(tree, leaf, rank, n_turns, formatted, loss_spans)``: one conversation per chosen path.

    ``nodes`` has ``tree, id, parent, role, text, score``. ``loss_spans`` are the code points of ``formatted`` from and to
    which the loss counts: each text of ``loss_role``, in order. Null roles and texts are empty. Of messages that repeat an id the
    first is told (``first_messages``); ``distinct_ids`` says that there are none.
    """
    if not distinct_ids:
        nodes = cut(first_messages(nodes))
    marked = F.concat(F.lit(OPEN), escaped(F.col("role"), True), F.lit(": "), escaped(F.col("text")), F.lit(END))
    turns = nodes.select("id", marked.alias("turn"), F.length(escaped(F.col("text"))).alias("size"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"))
    rows = paths(nodes, branches).join(turns, "id")
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("turn")).over(before) - len(END)
    rows = rows.withColumn("end", end.cast("long"))
    span = F.struct((F.col("end") - F.col("size")).alias("begin"), "end")
    told = rows.groupBy("tree", "leaf", "rank").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("depth", "turn"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("loss"), span))).alias("loss_spans"),
    )
    return told.select("tree", "leaf", "rank", "n_turns", F.array_join("turns.turn", "").alias("formatted"), "loss_spans")


def message_chains(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``nodes`` of flat conversations ``(conv, turn, role, text)``: every row replies to the one before it.

    Rows are ordered by turn (null first), then role and text, so repeated turns have a defined order. Positions come from
    one range sort of all rows; no conversation is one group.
    """
    rows = messages.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), "role", "text")
    rows, _, _ = numbered(rows, F.col("tree"), F.col("turn"), F.col("role"), F.col("text"), name="id")
    starts = rows.groupBy("tree").agg(F.min("id").alias("start"))
    rows = rows.join(starts.withColumnRenamed("tree", "__tree"), F.col("tree").eqNullSafe(F.col("__tree")))
    parent = F.when(F.col("id") > F.col("start"), F.col("id") - 1)
    return cut(rows.select("tree", "id", parent.alias("parent"), "role", "text", F.lit(1.0).alias("score")))


def _digests(batches):
    for batch in batches:
        out = []
        for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns = hashlib.sha256()
            n = 0
            for role, text, _, _ in turns_of(formatted):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            loss = "".join(unescaped(formatted[s["begin"] : s["end"]]) for s in spans)
            out.append((n, turns.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def digests(told: DataFrame) -> DataFrame:
    """``(tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read back from ``formatted`` and ``loss_spans``."""
    kind = told.schema["tree"].dataType.simpleString()
    schema = f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return told.select("tree", "formatted", "loss_spans").mapInArrow(_digests, schema)
