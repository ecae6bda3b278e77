"""Lempel-Ziv phrase fingerprints, and the likeness of each document to its edited text and its successor.

A text's UTF-8 bytes are parsed into dictionary phrases: each phrase is the longest earlier phrase plus one
byte (the last may repeat an earlier one). The set of phrases is hashed and its minimum-hash signature is the
fingerprint: the hash space is cut into ``size`` equal bins, each bin keeps its smallest hash, an empty bin borrows from
the next filled one, and one byte of each minimum is stored. Fingerprints are compared by the share of equal bytes,
corrected for the 1 in 256 that agree by chance; that estimates the Jaccard likeness of the phrase sets. Repeated structure
makes texts share long phrases, as a compressor would.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .textbytes import BLOCK_BYTES, blocks, mix, small_batches, span_hashes

_PRINTS = "fingerprint binary, edited_fingerprint binary, edited_sha256 binary, near_edited double, near_next double"


def _parse(data: bytes, node: int, known: dict[int, int], ends: list[int], at: int) -> int:
    """Go on parsing ``data`` from byte ``at``; the open phrase stands at ``node``. Adds phrase ends."""
    get = known.get
    new = len(known) + 1
    for i, c in enumerate(data[at:] if at else data, at + 1):
        key = node << 8 | c
        node = get(key, 0)
        if not node:
            known[key] = new
            new += 1
            ends.append(i)
    return node


def _signature(data: bytes, ends: list[int], size: int) -> bytes:
    if not data:
        return b""
    stop = np.array(ends if ends and ends[-1] == len(data) else [*ends, len(data)])
    start = np.concatenate([[0], stop[:-1]])
    hashes = np.sort(span_hashes(np.frombuffer(data, np.uint8), start, stop))
    edges = np.arange(size, dtype=np.uint64) << np.uint64(64 - size.bit_length() + 1)
    # the first hash at or after a bin's lower edge: its own minimum, or that of the next filled bin, going round
    at = np.searchsorted(hashes, edges)
    return mix(hashes[at % len(hashes)]).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated likeness of two fingerprints of one size, 0 to 1; two empty ones are alike."""
    if not a or not b:
        return float(a == b)
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / len(a)
    return max(0.0, (same - 1 / 256) / (255 / 256))


def fingerprint(text: str, size: int) -> bytes:
    """The signature of a whole text; empty for an empty text. ``size`` is a power of two."""
    data = text.encode("utf-8", "surrogatepass")
    ends: list[int] = []
    _parse(data, 0, {}, ends, 0)
    return _signature(data, ends, size)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def both_fingerprints(text: str, following: str, size: int) -> tuple[bytes, bytes, str]:
    """Fingerprints of the text and its edited text, and the edited text; the common front is parsed once."""
    data = text.encode("utf-8", "surrogatepass")
    half = len(text) // 2
    front = len(text[: len(text) - half].encode("utf-8", "surrogatepass"))
    known: dict[int, int] = {}
    ends: list[int] = []
    node = _parse(data[:front], 0, known, ends, 0)
    other = edited(text, following)
    other_data = other.encode("utf-8", "surrogatepass")
    other_known, other_ends = known.copy(), ends.copy()
    _parse(data, node, known, ends, front)
    _parse(other_data, node, other_known, other_ends, front)
    return _signature(data, ends, size), _signature(other_data, other_ends, size), other


def _row(text: str, following: str, after: bytes | None, size: int):
    """``after``: the fingerprint of the following text where it is known."""
    own, other, changed = both_fingerprints(text, following, size)
    after = fingerprint(following, size) if after is None else after
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest()
    return own, [own, other, sha, likeness(own, other), likeness(own, after)]


_NAMES = ["id", "n_chars", "fingerprint", "edited_fingerprint", "edited_sha256", "near_edited", "near_next", "edge", "text"]
FIRST, LAST = 1, 2


def _batch(id_type, ids, texts, rows, edges):
    """``rows``: what ``_row`` gives, or Nones; the text goes along on the edges of a range only."""
    kinds = [id_type, pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.string()]
    held = [t if e else None for t, e in zip(texts, edges, strict=True)]
    columns = [ids, [len(t) for t in texts], *(list(c) for c in zip(*rows, strict=True)), edges, held]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def _strings(column):
    return [t or "" for t in column.to_pylist()]


def _sorted_range(size: int):
    """Rows of one sorted range; all but the last have their successor at hand. ``edge`` marks first and last row.

    Goes backwards over each block, so that every fingerprint is made once or twice.
    """

    def run(batches):
        held, first, id_type = None, FIRST, None
        for batch in blocks(batches, "text", BLOCK_BYTES):
            id_type = batch.schema.field("id").type
            ids, texts = batch.column("id").to_pylist(), _strings(batch.column("text"))
            if held:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(texts) > 1:
                after, rows = fingerprint(texts[-1], size), []
                for text, following in zip(texts[-2::-1], texts[:0:-1], strict=True):
                    after, row = _row(text, following, after, size)
                    rows.append(row)
                edges = [first] + [0] * (len(rows) - 1)
                yield _batch(id_type, ids[:-1], texts[:-1], rows[::-1], edges)
                first = 0
        if held:
            yield _batch(id_type, [held[0]], [held[1]], [[None] * 5], [first | LAST])

    return run


def _pairs(size: int):
    def run(batches):
        for batch in blocks(batches, "text"):
            texts = _strings(batch.column("text"))
            rows = [_row(a, b, None, size)[1] for a, b in zip(texts, _strings(batch.column("following")), strict=True)]
            yield _batch(batch.schema.field("id").type, batch.column("id").to_pylist(), texts, rows, [0] * len(rows))

    return run


def phrase_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 128, part_bytes: int = 8 << 20
) -> DataFrame:
    """``(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every row.

    Rows are ordered by id (null ids first, equal ids by text); the row after the last is the first. The edited text has the
    last ``floor(n_chars / 2)`` code points replaced by the first as many of the next row's text. Null texts are empty;
    an empty text has an empty fingerprint, and two empty ones have likeness 1. With one row, it is its own successor.

    Texts are shuffled once, into sorted ranges of ids. A range's last row meets its successor in a
    second step that holds two rows per range.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_chars long, {_PRINTS}, edge int, text string"
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("id").asc_nulls_first(), F.xxhash64("text"), "text"
    )
    with small_batches(docs.sparkSession):
        done = cut(ordered.mapInArrow(_sorted_range(size), schema).withColumn("part", F.spark_partition_id()))
    # one number per range that has rows, whatever the ranges hold
    heads = done.filter(F.col("edge").bitwiseAND(FIRST) > 0).select(F.col("part").alias("head"), F.col("text").alias("following"))
    order = Window.orderBy("head")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("head").select(
        F.col("head").alias("part"),
        F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("head"),
    )
    lasts = done.filter(F.col("edge").bitwiseAND(LAST) > 0).select("id", "text", "part")
    met = lasts.join(after, "part").join(heads, "head").select("id", "text", "following").mapInArrow(_pairs(size), schema)
    out = done.filter(F.col("edge").bitwiseAND(LAST) == 0).drop("part").unionByName(met)
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        *(F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
        "near_edited",
        "near_next",
    )
