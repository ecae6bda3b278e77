"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``order`` bytes with the counts of the next byte.
A byte costs what an arithmetic coder with escape method C would spend: from the longest
context down, an escape where the byte was never seen there, bytes already refused are excluded, and
below the empty context the bytes never seen share the rest evenly. Statistics are frozen after
training, so the cost of a byte depends on its ``order + 1`` byte window only and a text's code
length is a sum over its windows. The language with the shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textbytes import _offsets, blocks

GRAMS = "lang string, gram long, n long"
UNKNOWN = "und"


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the test fold: crc32 of the id as text, mod ``folds``, is 0; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def sample_by_label(rows: DataFrame, label: str, per_label: int, text: str) -> DataFrame:
    """About ``per_label`` distinct texts of each label at most, as ``(label, text)``: those whose hash falls under the
    label's share ``per_label / distinct texts``, so that copies of a text count and come once, a label with few texts gives them
    all however often they stand, and a label's rows are never gathered to choose.
    """
    h = F.xxhash64(text)
    known = rows.select(F.col(label).alias("__l"), h.alias("__h")).distinct()
    shares = known.groupBy("__l").agg((F.lit(float(per_label)) / F.count(F.lit(1))).alias("__share"))
    shares = cut(shares)  # one row per label; its true size decides how it meets the rows
    place = F.pmod(h, F.lit(1 << 32)) / float(1 << 32)
    chosen = rows.join(shares, (F.col(label) == F.col("__l")) & (place < F.col("__share")))
    return chosen.select(label, text, h.alias("__h")).dropDuplicates([label, "__h"]).drop("__h")


def windows(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``order + 1`` byte windows of the texts as integers, and each text's first window and length.

    Every text is preceded by ``order`` newlines, so its first bytes have a context too.
    """
    column = column.fill_null("")
    offsets = _offsets(column)
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = np.insert(raw, np.repeat(offsets, order), 10)
    kind = np.uint32 if order < 4 else np.uint64
    n = len(data) - order
    out = np.zeros(n, kind)
    for i in range(order + 1):
        out = (out << kind(8)) | data[i : n + i].astype(kind)
    return out, offsets[:-1] + np.arange(len(column)) * order, np.diff(offsets)


def _count(order: int):
    def run(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in blocks(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            w, first, length = windows(batch.column("text"), order)
            owner = np.repeat(np.arange(len(length)), length)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + first[owner]
            for lang in set(langs):
                got, n = np.unique(w[at[(langs == lang)[owner]]], return_counts=True)
                if lang in total:
                    old, m = total[lang]
                    got, where = np.unique(np.concatenate([old, got]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([m, n])).astype(np.int64)
                total[lang] = got, n
        for lang, (got, n) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(got), pa.string()), pa.array(got.astype(np.uint64).view(np.int64)), pa.array(n, pa.int64())],
                ["lang", "gram", "n"],
            )

    return run


class _Contexts:
    """One language: for every order k, contexts and context+byte counts as sorted arrays."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        self.pairs, self.ctx = [], []
        for k in range(order + 1):
            keep = grams & np.uint64((1 << (8 * (k + 1))) - 1) if k < 7 else grams
            keys, inverse = np.unique(keep, return_inverse=True)
            self.pairs.append((keys, np.bincount(inverse, counts, len(keys))))
        for k, (keys, c) in enumerate(self.pairs):
            ctx, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
            n = np.bincount(inverse, c, len(ctx))
            d = np.bincount(inverse, minlength=len(ctx)).astype(float)
            below = np.zeros(len(ctx))
            if k:  # what the bytes seen here weigh in the next shorter context
                short = self._of(k - 1, keys & np.uint64((1 << (8 * k)) - 1))
                below = np.bincount(inverse, short, len(ctx))
            self.ctx.append((ctx, n, d, below))

    def _of(self, k: int, key: np.ndarray) -> np.ndarray:
        keys, c = self.pairs[k]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, c[at], 0.0)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each window."""
        out = np.zeros(len(grams))
        open_ = np.ones(len(grams), bool)
        gone_n = np.zeros(len(grams))
        gone_d = np.zeros(len(grams))
        for k in range(self.order, -1, -1):
            key = grams & np.uint64((1 << (8 * (k + 1))) - 1) if k < 7 else grams
            ctx, n, d, below = self.ctx[k]
            at = np.minimum(np.searchsorted(ctx, key >> np.uint64(8)), len(ctx) - 1)
            here = open_ & (ctx[at] == key >> np.uint64(8))
            c = np.where(here, self._of(k, key), 0.0)
            total = n[at] - gone_n + d[at] - gone_d
            seen = c > 0
            out[seen] += np.log2(total[seen] / c[seen])
            miss = here & ~seen & (d[at] > gone_d)
            out[miss] += np.log2(total[miss] / (d[at] - gone_d)[miss])
            open_ &= ~seen
            gone_n = np.where(here, below[at], 0.0)
            gone_d = np.where(here, d[at], 0.0)
        out[open_] += np.log2(np.maximum(256 - len(self.pairs[0][0]), 1))
        return out


@dataclass
class Model:
    """Frozen statistics of all languages, and the costs of all windows met in training.

    ``slots`` is an open hash table of rows of ``keys`` and ``costs``.
    """

    order: int
    langs: list[str]
    trees: list[_Contexts]
    keys: np.ndarray
    costs: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, order: int, grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        langs = sorted(grams)
        trees = [_Contexts(*grams[x], order) for x in langs]
        keys = np.unique(np.concatenate([grams[x][0] for x in langs])) if langs else np.zeros(0, np.uint64)
        costs = np.stack([t.bits(keys) for t in trees], 1).astype(np.float32) if langs else np.zeros((0, 0), np.float32)
        size = 1 << max(4, int(len(keys) * 3).bit_length())
        slots = np.full(size, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = _slot(keys, size)
        while len(todo):
            free = slots[slot[todo]] < 0
            slots[slot[todo[free]]] = todo[free]
            todo = todo[slots[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & (size - 1)
        return cls(order, langs, trees, keys, costs, slots)

    def _find(self, w: np.ndarray) -> np.ndarray:
        """Row of each window, -1 where training never met it."""
        size = len(self.slots)
        row = self.slots[_slot(w, size)]
        wrong = np.flatnonzero((row >= 0) & (self.keys[row] != w))
        slot = _slot(w[wrong], size)
        while len(wrong):
            slot = (slot + 1) & (size - 1)
            row[wrong] = self.slots[slot]
            still = (row[wrong] >= 0) & (self.keys[row[wrong]] != w[wrong])
            wrong, slot = wrong[still], slot[still]
        return row

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """Bits of each whole text under each language."""
        w, first, length = windows(column, self.order)
        row = self._find(w)
        new = np.flatnonzero(row < 0)
        cost = self.costs[np.maximum(row, 0)]
        if len(new):
            keys, inverse = np.unique(w[new], return_inverse=True)
            keys = keys.astype(np.uint64)
            cost[new] = np.stack([t.bits(keys) for t in self.trees], 1)[inverse]
        edges = np.stack([first, first + length], 1).ravel()
        sums = np.add.reduceat(np.vstack([cost, np.zeros((1, cost.shape[1]), np.float32)]), np.minimum(edges, len(cost)), axis=0, dtype=np.float64)[::2]
        sums[length == 0] = 0
        return sums


def _slot(w: np.ndarray, size: int) -> np.ndarray:
    h = w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def train(labelled: DataFrame, order: int = 3, docs_per_language: int = 2_000) -> Model:
    """Byte statistics of labelled rows ``(text, lang)``.

    Learns from at most about ``docs_per_language`` whole texts of each language, chosen by hash, so what
    reaches the driver is bounded by their bytes whatever the corpus; null labels or texts teach nothing.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sample = sample_by_label(rows, "lang", docs_per_language, "text")
    counts = sample.mapInArrow(_count(order), GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    langs = np.array(got["lang"].to_pylist(), object)
    gram = got["gram"].to_numpy().view(np.uint64)
    n = got["n"].to_numpy()
    return Model.of(order, {x: (gram[langs == x], n[langs == x].astype(float)) for x in sorted(set(langs))})


_TAGS = ["lang_pred", "score", "bits_per_byte"]


def _score(model, text: str, keep: list[str]):
    """Adds ``_TAGS`` to the columns ``keep``; the column ``text`` has the texts, ``letters`` whether they have one."""

    def run(batches):
        m: Model = model.value
        for batch in blocks(batches, text):
            letters = np.array(batch.column("letters").to_pylist(), bool)
            if m.langs:
                bits = m.code_lengths(batch.column(text))
                least = bits.min(axis=1)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                per_byte = least / np.maximum(np.diff(_offsets(batch.column(text).fill_null(""))), 1)
            else:
                letters[:] = False
                best, share, per_byte = np.zeros(len(letters), int), np.zeros(len(letters)), np.zeros(len(letters))
            names = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
            tags = [pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(np.where(letters, per_byte, 0.0))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *tags], [*keep, *_TAGS])

    return run


def tagged(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``lang_pred``, ``score`` and ``bits_per_byte`` added, overwriting
    columns of these names.

    ``score`` is the share of the chosen language when code lengths are read as probabilities with equal
    priors; equal lengths choose the first language in code point order. A null text, a text without a letter
    and any text when nothing was learned give ``und`` with score 0. Rows may repeat and hold nulls anywhere else.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c not in _TAGS]
    inner = [f"c{i}" for i in range(len(names))]
    text = F.col(text_col)
    rows = docs.select(*(F.col(c).alias(i) for c, i in zip(names, inner, strict=True)), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    source = "text"
    if text_col in names:  # the text goes through once
        source = inner[names.index(text_col)]
        rows = rows.drop("text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in inner)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_score(shared, source, inner), f"{schema}, lang_pred string, score double, bits_per_byte double")
    return out.select(*(F.col(i).alias(c) for c, i in zip(names, inner, strict=True)), *_TAGS)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score, bits_per_byte)``, one row per row of ``docs``; see ``tagged``."""
    return tagged(docs, model, text_col, [id_col])
