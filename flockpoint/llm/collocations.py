"""Collocations: phrases of two to ``longest`` words that stand together more often than their parts would by chance.

Phrases are counted in tries with hash containers. The trie of a task is shallow: its root leads from a word id to a hash
table of the words that follow, and only a table that grows beyond ``burst`` keys becomes a node with a table per next
word. When a task's trie holds ``room`` keys, the largest subtrees leave whole, as runs sorted by prefix partition and prefix. Spark
brings the runs of a prefix partition together and they are merged there. A partition is a hash of the first word and eight
bits of the second, so the phrases that begin with a frequent word are spread over 256 partitions.

A phrase is never more frequent than a part of it. So the texts are read three times, for words, for pairs of frequent words,
and for longer phrases all of whose pairs are frequent. What is frequent comes to the tasks as a bitmap of
``2^BITS`` bits; two phrases on one bit cost some counting and change no count.

Words are known by 64-bit hashes of language and word; texts of words come back for the ranked phrases only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread_over
from .textbytes import Texts, blocks, mix, small_batches, span_hashes

#: Bits of a bitmap, 8 MB whatever the input.
BITS = 26
MASK = (1 << BITS) - 1
#: Bytes between words of a piece, and bytes that end a piece.
_KIND = np.zeros(256, np.int8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Container(dict):
    """The rest of a phrase (bytes of word ids) and its count."""


class Node(dict):
    """The next word id (8 bytes) and the container or node below it."""


class HatTrie:
    """Counts of rows of ``width`` word ids; 0 stands for no word.

    ``size`` is the number of keys. A container bursts beyond ``burst`` keys unless one word is all that is left.
    """

    def __init__(self, width: int, burst: int = 8192):
        self.width, self.burst = width, burst
        self.root: dict[int, Container | Node] = {}
        self.keys: dict[int, int] = {}
        self.size = 0

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct rows (sorted or not) with their counts."""
        root, rest = self.root, self.width - 1
        tails = np.ascontiguousarray(rows[:, 1:]).view(f"V{8 * rest}").ravel().tolist()
        touched = set()
        for first, tail, c in zip(rows[:, 0].tolist(), tails, counts.tolist(), strict=True):
            box = root.get(first)
            if box is None:
                box = root[first] = Container()
                self.keys[first] = 0
            if type(box) is Node:
                box, tail = self._down(box, tail)
            had = box.get(tail)
            if had is None:
                box[tail] = c
                self.keys[first] += 1
                self.size += 1
                if len(box) > self.burst:
                    touched.add(first)
            else:
                box[tail] = had + c
        for first in touched:
            root[first] = self._burst(root[first])

    def _down(self, node: Node, tail: bytes):
        while True:
            head, tail = tail[:8], tail[8:]
            box = node.get(head)
            if box is None:
                box = node[head] = Container()
            if type(box) is Container:
                return box, tail
            node = box

    def _burst(self, box: Container | Node) -> Container | Node:
        if type(box) is Node:
            for k, kid in box.items():
                box[k] = self._burst(kid)
            return box
        if len(box) <= self.burst or len(next(iter(box))) <= 8:
            return box
        node = Node()
        for tail, c in box.items():
            node.setdefault(tail[:8], Container())[tail[8:]] = c
        return self._burst(node)

    def _tables(self, box: Container | Node, path: bytes) -> Iterator[tuple[bytes, Container]]:
        if type(box) is Container:
            yield path, box
        else:
            for k, kid in box.items():
                yield from self._tables(kid, path + k)

    def spill(self, down_to: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out whole subtrees, largest first, until ``down_to`` keys are left: ``(rows, counts)``, sorted by row."""
        gone, left = [], self.size
        for first in sorted(self.keys, key=lambda k: (-self.keys[k], k)):
            if left <= down_to:
                break
            gone.append(first)
            left -= self.keys[first]
        if not gone:
            return
        tails, counts, sizes = [], [], []
        for first in gone:
            for path, box in self._tables(self.root.pop(first), b""):
                tails.append(b"".join([path + k for k in box] if path else box))
                counts += box.values()
            sizes.append(self.keys.pop(first))
        self.size = left
        rest = np.frombuffer(b"".join(tails), np.uint64).reshape(-1, self.width - 1)
        rows = np.column_stack([np.repeat(np.array(gone, np.uint64), sizes), rest])
        order = np.lexsort(rows.T[::-1])
        yield rows[order], np.array(counts, np.int64)[order]


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _tokens(batch: pa.RecordBatch, seeds: dict[str, int]):
    """Bytes, word starts and ends, ids, the text of each word, and whether the next word is in the same piece."""
    texts = Texts(batch.column("text"))
    data = texts.lowered()
    kind = _KIND[data]
    step = np.diff((kind == 0).view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    breaks = np.cumsum(kind == 2, dtype=np.int32)
    joined = np.zeros(len(start), bool)
    joined[:-1] = breaks[start[1:]] == breaks[end[:-1] - 1]
    owner = np.searchsorted(texts.starts, start, "right") - 1
    of = np.zeros(texts.n, np.uint64)
    for i, lang in enumerate(batch.column("lang").to_pylist()):
        if lang not in seeds:
            seeds[lang] = _seed(lang)
        of[i] = seeds[lang]
    ids = mix(span_hashes(data, start, end) ^ of[owner])
    return data, start, end, np.maximum(ids, np.uint64(1)), owner, joined


def _in(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _word_place(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(64 - BITS)).astype(np.int64)


def _pair_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a >> np.uint64(64 - BITS)) ^ ((b >> np.uint64(12)) & np.uint64(MASK))).astype(np.int64)


def _bitmap(rows: DataFrame, place: Column) -> np.ndarray:
    """Bits at the places of the rows, at most ``2^BITS / 8`` bytes from Spark."""
    pages = rows.select(place.alias("p")).groupBy((F.col("p") / 32768).cast("int").alias("page"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for page, bits in pages.agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect():
        out[page * 4096 : (page + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


WORDS = "lang string, id long, word string, c long"


def _count_words(room: int):
    """Rows ``WORDS``; without a word: all words of the language."""

    def run(batches):
        seeds: dict[str, int] = {}
        total: dict[str, int] = {}
        boxes: dict[str, Container] = {}

        def spill(langs):
            for lang in langs:
                box = boxes.pop(lang)
                ids, told = sorted(box), [box[k] for k in sorted(box)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(ids), pa.string()), _long(np.array(ids, np.uint64)), pa.array([w.decode() for _, w in told], pa.string()), pa.array([c for c, _ in told], pa.int64())],
                    ["lang", "id", "word", "c"],
                )

        for batch in blocks(batches, "text"):
            data, start, end, ids, owner, _ = _tokens(batch, seeds)
            langs = np.array(batch.column("lang").to_pylist(), object)
            got, shown, n = np.unique(ids, return_index=True, return_counts=True)
            of = langs[owner[shown]]
            a, b = start[shown].tolist(), end[shown].tolist()
            raw = data.tobytes()
            for k, lang, i, j, c in zip(got.tolist(), of.tolist(), a, b, n.tolist(), strict=True):
                box = boxes.get(lang)
                if box is None:
                    box = boxes[lang] = Container()
                had = box.get(k)
                box[k] = (c + had[0], had[1]) if had else (c, raw[i:j])
                total[lang] = total.get(lang, 0) + c
            while sum(map(len, boxes.values())) > room:
                yield from spill([max(boxes, key=lambda x: len(boxes[x]))])
        yield from spill(list(boxes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([0] * len(total), pa.int64()), pa.array([None] * len(total), pa.string()), pa.array(list(total.values()), pa.int64())],
            ["lang", "id", "word", "c"],
        )

    return run


RUNS = "part int, run binary"


def _partition(rows: np.ndarray, parts: int) -> np.ndarray:
    return (mix(rows[:, 0] ^ (rows[:, 1] >> np.uint64(56))) % np.uint64(parts)).astype(np.int32)


def _count_phrases(shared, least: int, longest: int, parts: int, room: int, burst: int):
    """Rows ``RUNS``: for each prefix partition phrases of ``least`` to ``longest`` words, all of whose words (pairs, from three words
    on) are in the bitmap, with their counts; each run is sorted by words."""

    def runs(rows: np.ndarray, counts: np.ndarray):
        part = _partition(rows, parts)
        order = np.argsort(part, kind="stable")
        part, rows, counts = part[order], rows[order], counts[order].astype(np.uint64)
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        table = np.column_stack([rows, counts])
        for at in range(0, len(heads), 512):
            here = heads[at : at + 512]
            ends = np.append(here[1:], heads[at + 512] if at + 512 < len(heads) else len(part))
            told = [table[i:j].tobytes() for i, j in zip(here.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[here]), pa.array(told, pa.binary())], ["part", "run"])

    def run(batches):
        bitmap, seeds, trie = shared.value, {}, HatTrie(longest, burst)
        for batch in blocks(batches, "text"):
            *_, ids, _, joined = _tokens(batch, seeds)
            if least == 2:
                good = _in(bitmap, _word_place(ids))
                joined[:-1] &= good[:-1] & good[1:]
            else:
                joined[:-1] &= _in(bitmap, _pair_place(ids[:-1], ids[1:]))
            # from each word, the words up to the end of its chain, at most ``longest``
            chain = joined.copy()
            for k in range(1, least - 1):
                chain[: len(ids) - k] &= joined[k:]
                chain[len(ids) - k :] = False
            at = np.flatnonzero(chain)
            rows = np.zeros((len(at), longest), np.uint64)
            key = np.zeros(len(at), np.uint64)
            on = np.arange(len(at))
            for k in range(longest):
                rows[on, k] = ids[at[on] + k]
                on = on[joined[at[on] + k]]
            for k in range(longest):
                key = mix((key ^ rows[:, k]) + np.uint64(k + 1))
            _, shown, n = np.unique(key, return_index=True, return_counts=True)
            trie.add(rows[shown], n)
            if trie.size > room:
                for part in trie.spill(room // 2):
                    yield from runs(*part)
        for part in trie.spill(0):
            yield from runs(*part)

    return run


def _merge_runs(keep: int, least: int, longest: int):
    """Rows ``w1 .. w<longest>, a``: what the runs of each prefix partition say together, for phrases with ``keep`` occurrences or more.

    Runs come sorted by partition. A run has a row per longest phrase; its beginnings of ``least`` words or more are phrases too.
    """
    names = [*[f"w{i + 1}" for i in range(longest)], "a"]

    def merged(runs: list[bytes]):
        table = np.frombuffer(b"".join(runs), np.uint64).reshape(-1, longest + 1)
        found = []
        for k in range(least, longest + 1):
            rows = table[table[:, k - 1] != 0] if k > least else table
            key = np.zeros(len(rows), np.uint64)
            for i in range(k):
                key = mix((key ^ rows[:, i]) + np.uint64(i + 1))
            order = np.argsort(key, kind="stable")
            key = key[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            if not len(heads):
                break
            total = np.add.reduceat(rows[order, longest].astype(np.int64), heads)
            many = total >= keep
            some = np.zeros((np.count_nonzero(many), longest), np.uint64)
            some[:, :k] = rows[order[heads[many]], :k]
            found.append((some, total[many]))
        rows, counts = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        columns = [_long(np.ascontiguousarray(rows[:, i])) for i in range(longest)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names)

    def run(batches):
        held, at = [], None
        for batch in batches:
            for part, told in zip(batch.column("part").to_pylist(), batch.column("run"), strict=True):
                if part != at and held:
                    yield merged(held)
                    held = []
                at = part
                held.append(told.as_py())
        if held:
            yield merged(held)

    return run


def phrase_counts(docs: DataFrame, least: int, longest: int, room: int, burst: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, id, word, c)`` of words with at least ``least`` occurrences and, without a word, each language's number of all words;
    ``(words array<long>, a)`` of all phrases of up to ``longest`` words with at least ``least`` occurrences. Docs are ``(lang, text)``.

    A merge holds one prefix partition; there are 16 for each of the session's shuffle partitions, so they stay as small as those.
    """
    spark = docs.sparkSession
    rare = (F.col("c") >= least) | F.col("word").isNull()

    parts = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def counted(shared, low: int, high: int) -> DataFrame:
        runs = docs.mapInArrow(_count_phrases(shared, low, high, parts, room, burst), RUNS)
        kind = ", ".join(f"{c} long" for c in [*[f"w{i + 1}" for i in range(high)], "a"])
        return cut(spread_over(runs, "part").sortWithinPartitions("part").mapInArrow(_merge_runs(least, low, high), kind))

    with small_batches(spark):
        words = cut(docs.mapInArrow(_count_words(room), WORDS).groupBy("lang", "id", "word").agg(F.sum("c").alias("c")).filter(rare))
        known = words.filter(F.col("word").isNotNull())
        found = [known.select(F.array("id").alias("words"), F.col("c").alias("a"))]
        top = lambda c: F.shiftrightunsigned(c, 64 - BITS)
        shared = spark.sparkContext.broadcast(_bitmap(known, top("id")))
        pairs = counted(shared, 2, 2)
        shared.unpersist()
        found.append(pairs.select(F.array("w1", "w2").alias("words"), "a"))
        if longest > 2:
            place = top("w1").bitwiseXOR(F.shiftrightunsigned("w2", 12).bitwiseAND(F.lit(MASK)))
            shared = spark.sparkContext.broadcast(_bitmap(pairs, place))
            long = counted(shared, 3, longest)
            shared.unpersist()
            found.append(long.select(F.filter(F.array(*[f"w{i + 1}" for i in range(longest)]), lambda x: x != 0).alias("words"), "a"))
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)
    return words, cut(counts)


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 100,
    longest: int = 5,
    top: int = 2000,
    share: int = 100,
    room: int = 400_000,
    burst: int = 8192,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases by score, a (both descending), phrase (by bytes).

    A-Z are lower-cased. Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words ``[^\\x20\\x09]+``. ``n`` counts a language's
    words, ``a`` the phrase's occurrences within pieces, overlaps included, ``least`` at least. A cut after the first words gives the counts
    ``l`` and ``r`` of both parts and the score ``floor(1000 a n / (l r))``; the lowest score counts, the earliest cut of equal ones. A phrase
    within a longer one that has ``share`` percent of its occurrences or more, is dropped.

    A null language is ``und``, a null text empty; repeated rows count as often as they stand. Other columns of any name are
    ignored. ``room`` and ``burst`` bound a task's memory and change no result.
    """
    source = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words, counts = phrase_counts(source, least, longest, room, burst)
    known = words.filter(F.col("word").isNotNull()).select("id", "lang", "word")
    totals = words.filter(F.col("word").isNull()).select("lang", F.col("c").alias("n"))
    phrases = counts.filter(F.size("words") > 1)
    # dropped: phrases in a longer one
    starts = F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)
    parts = phrases.filter(F.size("words") > 2).select("words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("k"))
    parts = parts.select(F.explode(F.transform(starts, lambda i: F.slice("words", i, F.col("k")))).alias("words"), "a")
    longer = parts.groupBy("words").agg(F.max("a").alias("most"))
    own = phrases.join(longer, "words", "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")
    head = known.join(totals, "lang").select("id", "lang", "n")
    own = cut(own.join(head, own["words"][0] == head["id"]).drop("id"))
    cuts = own.select("words", "lang", "a", "n", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.slice("words", F.col("k") + 1, F.size("words")))
    cuts = cuts.join(counts.select(F.col("words").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("words").alias("right"), F.col("a").alias("r")), "right")
    exact = "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    best = cuts.withColumn("score", F.expr(exact)).groupBy("words", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    best = best.select("words", "lang", "a", "best.l", "best.r", "n", "best.score")
    by_value = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = cut(best.withColumn("place", F.rank().over(by_value)).filter(F.col("place") <= top).drop("place"))
    spelt = best.select("words", F.posexplode("words").alias("i", "id")).join(known.select("id", "word"), "id")
    spelt = spelt.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    told = best.join(spelt.select("words", F.array_join("w.word", " ").alias("phrase")), "words")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    told = told.withColumn("rank", rank).filter(F.col("rank") <= top)
    return told.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
