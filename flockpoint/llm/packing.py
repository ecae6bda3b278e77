"""Packing token runs into sequences of a fixed length by hierarchical best fit.

Every document becomes pieces of at most ``capacity`` tokens. Pieces are dealt to groups; each group packs its own by best
fit, longest first. Bins that are at least nearly full are done; the others go on as single items, and groups
are merged into fewer for the next round, until one group is left or a round neither merges groups nor saves
one bin in a hundred. A bin carries the pieces it holds, at most ``capacity`` of them, so no round needs a join.
Rounds work on numbers only; texts are read once.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textbytes import blocks, small_batches

#: Words, and parts of words, that a Python worker keeps with their ids before it starts anew.
CACHED_WORDS = 250_000
CACHED_PARTS = 450_000
#: The id that ends every document.
END = np.zeros(1, "<u4").tobytes()

_encoders: dict[str, Encoder] = {}

#: A word of these only is split here as the vocabulary's own rules split it; lower-casing and composing leave no doubt for them.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The vocabulary's rule for parts of words, for the characters of ``_PLAIN`` in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """What stands for the UTF-8 bytes of each plain character: printable bytes for themselves, the rest from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(192, 256)}


_LETTERS = _byte_letters()


class _Known(dict):
    """Ids of words as little-endian 32-bit numbers, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.make(word)
        return ids


class Encoder:
    """Token ids of texts, word by word.

    For vocabularies that split at spaces and newlines and drop them: a text's ids are those of its words in a row. Plain
    words are split into parts here, whose ids are kept as well; other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts = _Known(self._part)
        self.words = _Known(self._word)

    def _part(self, part: str) -> bytes:
        part = part if part.isascii() else part.translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.parts[word.lower()]
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches):
        for batch in blocks(batches, "text"):
            texts = batch.column("text").fill_null("").to_pylist()
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            encode = encoder(path).ids
            for i, text in enumerate(texts):
                ids = encode(text) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    owner.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [batch.column("id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: the ids of every whole text and a closing 0, cut every ``capacity``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(_pieces(vocabulary, capacity, with_ids), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, each into the fullest bin that has room.

    Bins are kept by their room; the bits of ``open_`` tell which rooms there are.
    """
    place = np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = bins = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_ >> size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + size
            b = by_room[room].pop()
            if not by_room[room]:
                open_ &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        place[i] = b
        room -= size
        if room:
            by_room[room].append(b)
            open_ |= 1 << room
    return place


def _pack(capacity: int):
    """Pack one group's items; each comes back inside the bin that holds it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        used = table["used"].to_numpy()
        members = table["members"].chunk(0)
        place = best_fit(used, capacity)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(place.max() + 2))
        filled = np.concatenate([[0], np.cumsum(used[order])])
        inside = filled[:-1] - np.repeat(filled[bounds[:-1]], np.diff(bounds))  # where an item begins in its bin
        sizes = np.diff(members.offsets.to_numpy())[order]
        begin = members.offsets.to_numpy()[:-1][order]
        flat = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        held = members.values.take(pa.array(flat))
        names = [f.name for f in held.type]
        columns = dict(zip(names, held.flatten(), strict=True))
        columns["offset"] = pa.array(columns["offset"].to_numpy() + np.repeat(inside, sizes))
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([columns[k].cast(held.type.field(k).type) for k in names], names))
        return pa.table({"used": pa.array(filled[bounds[1:]] - filled[bounds[:-1]], pa.int64()), "members": lists})

    return run


def pack(pieces: DataFrame, capacity: int = 2048, nearly: float = 0.995, group_items: int = 20_000, fan_in: int = 8) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless sequences of at most ``capacity`` tokens.

    ``pieces`` has ``id, piece, start, length, ids_crc32``, lengths 1 to ``capacity``. A group packs about ``group_items``
    items at once; ``fan_in`` groups merge into one, unless that makes it larger. Rows may repeat; an empty table stays empty.
    """
    item = F.struct("id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    with small_batches(pieces.sparkSession):
        items = cut(pieces.select(F.col("length").alias("used"), F.array(item).alias("members")))
    done = items.filter(F.col("used") >= capacity)
    items = items.filter(F.col("used") < capacity)
    schema = items.schema
    count = items.count()
    groups, turn = -(-count // group_items), 0
    while groups:
        first = F.col("members")[0]
        group = F.pmod(F.xxhash64(first["id"], first["piece"], first["ids_crc32"], F.lit(turn)), F.lit(groups))
        bins = cut(items.groupBy(group.alias("g")).applyInArrow(_pack(capacity), schema))
        full = F.col("used") >= nearly * capacity
        done = done.unionByName(bins.filter(full))
        items = bins.filter(~full)
        sizes = bins.agg(F.count(F.lit(1)).alias("bins"), F.count(F.when(~full, 1)).alias("left")).first()
        saved, left = count - sizes["bins"], sizes["left"]
        fewer = max(-(-groups // fan_in), -(-left // group_items))
        if groups == 1 or (fewer >= groups and saved < 0.01 * count):
            break
        groups, turn, count = min(groups, fewer), turn + 1, left
    done = done.unionByName(items)
    rows = done.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode("members").alias("m"))
    return rows.select("m.id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece of every row of ``docs``.

    Null texts are empty and give the closing id alone. Only documents longer than ``capacity`` are cut. Ids may be
    null or repeat: every row is packed. Other columns are ignored.
    """
    packed = pack(token_pieces(docs, vocabulary, capacity, id_col, text_col), capacity, **how)
    return packed.withColumnRenamed("id", id_col)


def _join_ids(table: pa.Table) -> pa.Table:
    order = np.argsort(table["offset"].to_numpy(), kind="stable")
    ids = b"".join(table["ids"].take(pa.array(order)).to_pylist())
    return pa.table({"sequence_id": table["sequence_id"].slice(0, 1), "ids": pa.array([np.frombuffer(ids, "<u4").astype(np.int32)], pa.list_(pa.int32()))})


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(sequence_id, ids)``: the sequences themselves, for documents with distinct ids."""
    tokens = token_pieces(docs, vocabulary, capacity, id_col, text_col, with_ids=True).select(F.col("id").alias(id_col), "piece", "ids")
    rows = packed.select(id_col, "piece", "sequence_id", "offset").join(tokens, [id_col, "piece"])
    return rows.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(_join_ids, "sequence_id long, ids array<int>")
