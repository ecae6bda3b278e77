"""Secret scans over a ledger of content-addressed blobs, with DataFrame functions only.

A version of a file is a row with a text; its blob is the SHA-256 of the text. The ledger is a Parquet folder with
one row per blob and scan: the rules that scan applied (``name@version``) and the spans that it found. An update hashes
all versions, looks their blobs up, and scans each blob once, by the rules for which the ledger has no entry: a new path
to a known text costs a hash, a new version of one rule costs that rule. Findings are joined back to every path.

Spans come from Java patterns without Python: ``split`` gives the text between matches and ``regexp_extract_all`` the matches,
both by the same leftmost non-overlapping search, so running sums of their lengths are the positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import attach, cut

FOUND = "array<struct<start:bigint,kind:int,rule:string,end:bigint>>"
MATCHES = "array<struct<kind:int,rule:string,i:int,gap:bigint,size:bigint,kept:boolean>>"
LEDGER = f"blob binary, rules array<string>, found {FOUND}"
#: Unseen blobs up to this many are looked up in the versions by a broadcast list of hashes (32 bytes each).
LISTED = 100_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; one stays where its ``group`` has at least ``least`` characters. ``version`` names the rule's text:
    raise it with every change, and all blobs are scanned by the rule anew."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


_ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)

#: Assigned secrets, access key ids, long hexadecimal runs; then key formats that announce themselves. A run is matched greedily
#: to its end, so a least length inside the pattern finds what a test of the matched run would keep; the words of an assignment
#: may be used up by a match that is too short, so that one is tested after the match.
BASE_RULES = (
    Rule("assign", 1, _ASSIGN, 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
RULES = (
    *BASE_RULES,
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("webtoken", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def blob_of(text: Column) -> Column:
    """Content address; a null text is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _matches(text: Column, rules: tuple[Rule, ...], todo: Column) -> Column:
    """All matches of the rules in ``todo``, in order per rule: ``(kind, rule, i, gap, size, kept)``."""
    found = []
    for kind, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        whole = F.regexp_extract_all(text, pattern, F.lit(0))
        tested = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
        # the pieces are one more than the matches; the last has no match after it
        zipped = F.transform(
            F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), tested.alias("part")),
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"),
                F.lit(rule.key).alias("rule"),
                i.cast("int").alias("i"),
                F.length(x["gap"]).cast("bigint").alias("gap"),
                F.length(x["hit"]).cast("bigint").alias("size"),
                (F.length(x["part"]) >= rule.least).alias("kept"),
            ),
        )
        hits = F.filter(zipped, lambda x: x["size"].isNotNull())
        asked = F.array_contains(todo, rule.key) & text.rlike(rule.pattern)
        found.append(F.when(asked, hits).otherwise(F.array().cast(MATCHES)))
    return F.concat(*found)


def scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of ``blobs (blob, text, todo)``: every blob once, by its ``todo`` rules."""
    rows = blobs.select("blob", "todo", F.explode_outer(_matches(F.col("text"), rules, F.col("todo"))).alias("m"))
    before = Window.partitionBy("blob", "m.kind").orderBy("m.i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(before)
    rows = rows.select("blob", "todo", "m", end.alias("end"))
    span = F.struct(
        (F.col("end") - F.col("m.size")).alias("start"), F.col("m.kind").alias("kind"), F.col("m.rule").alias("rule"), F.col("end").alias("end")
    )
    found = F.array_sort(F.collect_list(F.when(F.col("m.kept"), span)))
    return rows.groupBy("blob", "todo").agg(found.cast(FOUND).alias("found")).select("blob", F.col("todo").alias("rules"), "found")


class BlobLedger:
    """The ledger in folder ``path``, which every executor must reach. Each update appends; a failed one leaves nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
        """Scan the texts of ``versions`` that the ledger does not know yet under ``rules``.

        Null texts are empty texts; copies, repeated rows and null paths are one blob each text. Other columns are ignored.
        Two updates at the same time may scan a blob twice, which changes no finding.
        """
        texts = versions.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        asked = F.array(*[F.lit(r.key) for r in rules])
        seen = self.rows().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        todo = F.array_except(asked, F.coalesce("seen", F.array().cast("array<string>")))
        unseen = texts.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo"))
        unseen = cut(unseen.filter(F.size("todo") > 0))
        if unseen.limit(LISTED + 1).count() <= LISTED:
            texts = texts.join(F.broadcast(unseen.select("blob")), "blob", "left_semi")
        # copies fold where they are read, so a text with many paths is one row per task
        met = texts.dropDuplicates(["blob"]).join(unseen, "blob")
        scanned(met, rules).write.mode("append").parquet(self.path)

    def findings(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
        """``versions`` with ``blob`` and ``found`` added (overwriting columns of these names): all spans under the present ``rules``
        in code points, end exclusive, by start, then rule as listed. Texts that were never scanned have a null ``found``."""
        keys = [r.key for r in rules]
        kind = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("f.rule")).cast("int") - 1
        each = self.rows().select("blob", F.explode_outer("found").alias("f"))
        current = F.col("f.rule").isin(keys)
        span = F.when(current, F.struct("f.start", kind.alias("kind"), "f.rule", "f.end"))
        spans = each.groupBy("blob").agg(F.array_sort(F.collect_set(span)).cast(FOUND).alias("found"))
        kept = [c for c in versions.columns if c not in ("blob", "found")]
        rows = versions.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], blob_of(F.col(text_col)).alias("blob"))
        paths = rows.groupBy("blob").agg(F.count(F.lit(1)).alias("paths"))
        table = cut(paths.join(spans, "blob").select("blob", "found", "paths"))
        met = attach(rows, table, "blob", "paths", how="left")
        return met.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "blob", "found")


def spans_text(found: Column) -> Column:
    """``rule:start:end`` of the spans, comma-joined, without the rules' versions."""
    each = F.transform(found, lambda f: F.concat_ws(":", F.substring_index(f["rule"], "@", 1), f["start"].cast("string"), f["end"].cast("string")))
    return F.array_join(each, ",")
