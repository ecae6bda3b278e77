"""Periodic runs of words, found on a Re-Pair grammar of the texts.

A task compresses a block of texts together: in rounds, every pair of neighbouring symbols that stands twice or more
becomes a symbol of its own, wherever no overlapping pair is more frequent; what is left of a text is joined pairwise up to one
symbol. So each text is a binary tree whose repeated parts are the same node, and copies of a text are one node.

A run that lies in a text has a lowest node that holds all of it, and it crosses that node's boundary, the place where the
left child ends. So it is enough to look at each node once, for each period up to a ``power``-th of its length: a run of
that power has two periods on one side of the boundary, which one comparison of prefix hashes shows; binary searches on
hashes give both ends. What a node holds is then moved to every place where the node was put, and intervals of one
period that overlap by a period or more are merged. Found intervals are compared word by word; a node on which a hash was
wrong is searched without hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import Texts, Words, _tables, blocks, mix, small_batches, span_hashes

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Pairs of a node and a period that are tested together.
TESTS = 1 << 21


@dataclass
class Grammar:
    """Node k derives ``size[k]`` words, the first ``left[k]`` from its left child; it stands at word ``first[k]`` and,
    all in all, node ``node[i]`` stands at word ``at[i]``."""

    first: np.ndarray
    left: np.ndarray
    size: np.ndarray
    node: np.ndarray
    at: np.ndarray


def repair(words: np.ndarray, last: np.ndarray) -> Grammar:
    """The grammar of a row of word numbers; ``last`` marks the last word of each text, and no symbol goes beyond it."""
    s, last = words.astype(np.int64), last.copy()
    base = int(s.max(initial=-1)) + 1
    at, size, live = np.arange(len(s)), np.ones(len(s), np.int64), np.ones(len(s), bool)
    nodes, places, made = [], [], 0
    keys, named = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def put(sel: np.ndarray, ids: np.ndarray, fresh: np.ndarray):
        """Pairs at ``sel`` become symbols ``ids``; ``fresh`` are those of them that show a new node, in order."""
        nonlocal s, at, size, last, live
        nodes.append((at[fresh], size[fresh], size[fresh] + size[fresh + 1]))
        places.append((ids, at[sel]))
        live[sel] = True
        live[np.maximum(sel - 1, 0)] = True
        s[sel], last[sel] = ids + base, last[sel + 1]
        size[sel] += size[sel + 1]
        keep = np.ones(len(s), bool)
        keep[sel + 1] = False
        s, at, size, last, live = s[keep], at[keep], size[keep], last[keep], live[keep]

    while len(s) > 1:
        # a pair seen once stays unique, so only pairs seen twice in the last round and those beside new symbols are counted
        i = np.flatnonzero(live[:-1] & ~last[:-1])
        pair = (s[i] << 32) | s[i + 1]
        kinds, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        many = count[inverse] > 1
        i, pair = i[many], pair[many]
        if not len(i):
            break
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((kinds, count))] = np.arange(1, len(kinds) + 1)
        order = np.zeros(len(s) + 1, np.int64)
        order[i] = rank[inverse[many]]
        live = order[:-1] > 0
        # of one symbol many times in a row, every other pair
        starts = order[i] != order[np.maximum(i - 1, 0)]
        starts[0] = True
        begin = np.maximum.accumulate(np.where(starts, i, 0))
        before = np.where(i > 0, order[i - 1], 0)
        best = ((i - begin) % 2 == 0) & (before <= order[i]) & (order[i + 1] <= order[i])
        sel, pair = i[best], pair[best]
        kinds, shown, inverse = np.unique(pair, return_index=True, return_inverse=True)
        where = np.searchsorted(keys, kinds)
        old = np.zeros(len(kinds), bool)
        inside = where < len(keys)
        old[inside] = keys[where[inside]] == kinds[inside]
        ids = np.empty(len(kinds), np.int64)
        ids[old] = named[where[old]]
        ids[~old] = made + np.arange(np.count_nonzero(~old))
        made += np.count_nonzero(~old)
        keys, named = np.insert(keys, where[~old], kinds[~old]), np.insert(named, where[~old], ids[~old])
        put(sel, ids[inverse], sel[shown[~old]])
    while len(s) > 1:
        text_start = np.append(True, last[:-1])
        inside = np.arange(len(s)) - np.flatnonzero(text_start)[np.cumsum(text_start) - 1]
        sel = np.flatnonzero((inside % 2 == 0) & ~last)
        if not len(sel):
            break
        put(sel, made + np.arange(len(sel)), sel)
        made += len(sel)
    join = lambda rows, k: np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64)
    return Grammar(join(nodes, 0), join(nodes, 1), join(nodes, 2), join(places, 0), join(places, 1))


class _Same:
    """Comparisons of word spans by prefix hashes."""

    def __init__(self, hashes: np.ndarray):
        self.power = _tables(len(hashes) + 1)[0]
        self.sum = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.power[: len(hashes)], out=self.sum[1:])

    def __call__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``x`` are those from ``y >= x``."""
        return (self.sum[x + n] - self.sum[x]) * self.power[y - x] == self.sum[y + n] - self.sum[y]

    def reach(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far, up to ``most``, words from ``x`` and ``y`` on are the same; ``back``: words before them."""
        low, high = np.zeros(len(x), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self(x - mid, y - mid, mid) if back else self(x, y, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def plain_runs(words: np.ndarray, least: int, power: int) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of all runs, by comparing all words for every period."""
    best: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // power + 1):
        same = np.concatenate([[False], words[:-q] == words[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + q >= max(least, power * q):
                best.setdefault((a, b + q), q)
    return sorted((a, b, q) for (a, b), q in best.items())


def _crossing(words: np.ndarray, same: _Same, g: Grammar, least: int, power: int):
    """``(node, offset, length, period)`` of what crosses the boundaries of the nodes."""
    reps = np.where(g.size >= least, g.size // power, 0)
    cuts = np.searchsorted(np.cumsum(reps), np.arange(TESTS, reps.sum() + TESTS, TESTS))
    cuts = np.unique(np.append(0, np.minimum(cuts + 1, len(reps))))
    got = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        r = reps[lo:hi]
        node = np.repeat(np.arange(lo, hi), r)
        q = np.arange(len(node)) - np.repeat(np.cumsum(r) - r, r) + 1
        start = g.first[node]
        mid, end = start + g.left[node], start + g.size[node]
        for side in (0, 1):
            fits = (mid + 2 * q <= end) if side else (mid - 2 * q >= start)
            k = np.flatnonzero(fits)
            x = mid[k] if side else mid[k] - 2 * q[k]
            # most pairs differ in their first word
            k = k[words[x] == words[x + q[k]]]
            x = mid[k] if side else mid[k] - 2 * q[k]
            hit = same(x, x + q[k], q[k])
            k = k[hit]
            x, p = x[hit], q[k]
            right = same.reach(x, x + p, end[k] - x - p, False)
            left = same.reach(x, x + p, x - start[k], True)
            size = left + right + p
            long = size >= np.maximum(least, power * p)
            got.append(np.stack([node[k], x - left - start[k], size, p])[:, long])
    found = np.concatenate(got, axis=1) if got else np.zeros((4, 0), np.int64)
    # the same words under a multiple of their period
    found = found[:, np.lexsort((found[3], found[2], found[1], found[0]))]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:3, 1:] != found[:3, :-1]).any(axis=0)
    found = found[:, new]
    wrong = set()
    for k, offset, size, p in found.T.tolist():
        a = g.first[k] + offset
        if not np.array_equal(words[a : a + size - p], words[a + p : a + size]):
            wrong.add(k)
    if wrong:
        exact = [(k, a, b - a, p) for k in sorted(wrong) for a, b, p in plain_runs(words[g.first[k] : g.first[k] + g.size[k]], least, power)]
        found = found[:, ~np.isin(found[0], list(wrong))]
        found = np.concatenate([found, np.array(exact, np.int64).reshape(-1, 4).T], axis=1)
        found = found[:, np.argsort(found[0], kind="stable")]
    return found


def runs_of(words: np.ndarray, hashes: np.ndarray, last: np.ndarray, least: int, power: int) -> np.ndarray:
    """Rows ``start, end, period`` of all maximal runs, by start, then period; ``words`` are numbers from 0."""
    g = repair(words, last)
    found = _crossing(words, _Same(hashes), g, least, power)
    if not found.shape[1]:
        return np.zeros((3, 0), np.int64)
    per = np.bincount(found[0], minlength=len(g.size))
    begin = np.cumsum(per) - per
    used = per[g.node] > 0
    node, at = g.node[used], g.at[used]
    n = per[node]
    pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[node], n)
    start = np.repeat(at, n) + found[1][pick]
    end, p = start + found[2][pick], found[3][pick]
    order = np.lexsort((start, p))
    start, end, p = start[order], end[order], p[order]
    reach = np.maximum.accumulate(p * (len(words) + 1) + end) - p * (len(words) + 1)
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (start[1:] + p[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    start, p, end = start[heads], p[heads], reach[np.append(heads[1:], len(reach)) - 1]
    order = np.lexsort((p, end, start))
    rows = np.stack([start, end, p])[:, order]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    rows = rows[:, first]
    return rows[:, np.lexsort((rows[2], rows[0]))]


def _told(texts: Texts, words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    k = np.flatnonzero(kept)
    owner = np.repeat(np.arange(texts.n), words.counts)[k]
    start, size = words.start[k], words.end[k] - words.start[k]
    spaced = np.append(owner[1:] == owner[:-1], False)[: len(k)]
    room = size + spaced
    out = np.cumsum(room) - room
    data = texts.data[np.repeat(start - out, room) + np.arange(room.sum())]
    data[(out + size)[spaced]] = 32
    ends = np.cumsum(np.bincount(owner, room, texts.n).astype(np.int64)) if len(k) else np.zeros(texts.n, np.int64)
    offsets = np.append(0, ends).astype(np.int32)
    return pa.StringArray.from_buffers(texts.n, pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))


def _find(least: int, power: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in blocks(batches, "text"):
            texts = Texts(batch.column("text"))
            words = Words(texts)
            h = span_hashes(texts.data, words.start, words.end)
            last = np.zeros(len(h), bool)
            last[words.bounds[1:][words.counts > 0] - 1] = True
            start, end, p = runs_of(np.unique(h, return_inverse=True)[1], mix(h), last, least, power)
            covered = np.zeros(len(h) + 1, np.int64)
            np.add.at(covered, start + p, 1)
            np.add.at(covered, end, -1)
            kept = np.cumsum(covered[:-1]) == 0
            at = np.searchsorted(start, words.bounds)
            base = np.repeat(words.bounds[:-1], np.diff(at))
            each = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - start), pa.array(p)], fields=list(kind.value_type))
            runs = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), each).cast(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words.counts.astype(np.int64)), runs, _told(texts, words, kept)], ["id", "n_words", "runs", "collapsed"]
            )

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, power: int = 4) -> DataFrame:
    """``(id_col, n_words, runs, collapsed)``, one row per row of ``docs``.

    Words are runs of other than ``[\\x20\\x09-\\x0D]``, numbered from 0. A run is a stretch of words with smallest period q, at least
    ``max(least, power * q)`` long, that neither neighbour extends; ``runs`` has them by start, then period. ``collapsed`` is the
    text's words joined by one space, without those that a run contains after its first q words. ``power`` is 4 or more.

    A null, empty or wordless text has no words, no runs and collapses to an empty text. Repeated rows, null ids and ties
    are rows like others; other columns of any name are ignored. A text is worked on whole, by one task.
    """
    if power < 4 or least < 1:
        raise ValueError("power must be 4 or more, least 1 or more")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        kind = source.schema["id"].dataType.simpleString()
        found = source.mapInArrow(_find(least, power), f"id {kind}, n_words long, runs {RUNS}, collapsed string")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")
