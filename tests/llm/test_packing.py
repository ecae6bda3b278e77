import random
import zlib
from collections import defaultdict

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from flockpoint.llm.packing import Encoder, best_fit, pack, pack_documents, sequences

VOCABULARY = path("word_bpe_49k.json")


def test_words_equal_whole_texts():
    plain, own, rng = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY), random.Random(2)
    letters = list("abzAZ09'’.,!?-_#%<|>()\t\n  \r\x0b\x1c\x85\xa0 ÀÉß×÷ÿªºéñİΣςЯ漢٣²½") + ["'s", "'LL", "<|endoftext|>", "é", "\U0001f600", "don't"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 14)))
        want = np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.ids(text) == want, repr(text)


def test_best_fit_against_a_scan():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(1, 64, 300)
        place, room = best_fit(sizes, 64), []
        for i in np.argsort(-sizes, kind="stable"):
            fits = [b for b in range(len(room)) if room[b] >= sizes[i]]
            b = min(fits, key=lambda b: room[b], default=len(room))
            if b == len(room):
                room.append(64)
            # any bin with the least room will do
            assert room[place[i]] == room[b] if place[i] < len(room) else b == len(room)
            room[place[i]] -= sizes[i]
        filled = np.bincount(place, sizes)
        assert filled.max() <= 64 and len(filled) == len(room)


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_rounds_keep_every_piece(spark):
    rng = random.Random(7)
    pieces = [(i, 0, 0, rng.randint(1, 100), i) for i in range(3000)] + [(1, 0, 0, 60, 1)] * 50
    df = spark.createDataFrame(pieces, "id long, piece int, start long, length long, ids_crc32 long")
    rows = pack(df, 100, group_items=200).collect()
    assert sorted((r["id"], r["length"]) for r in rows) == sorted((p[0], p[3]) for p in pieces)
    assert check(rows, 100) <= 1.03 * sum(p[3] for p in pieces) / 100 + 30
    large = spark.createDataFrame([(i, 0, 0, 60, i) for i in range(700)], df.schema)
    assert check(pack(large, 100, group_items=100).collect(), 100) == 700  # none fit together; the rounds end


def test_documents(spark, edge, empty):
    plain = Tokenizer.from_file(VOCABULARY)
    rows = pack_documents(edge, VOCABULARY).collect()
    check(rows, 2048)
    want = []
    for r in edge.collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, (r[:5] for r in rows)), key=key) == sorted(want, key=key)
    assert pack_documents(empty, VOCABULARY).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * i) for i in range(40)], "doc_id long, text string")
    packed = pack_documents(docs, VOCABULARY, 64)
    runs = {r["sequence_id"]: list(r["ids"]) for r in sequences(docs, packed, VOCABULARY, 64).collect()}
    for r in packed.collect():
        part = np.array(runs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(part) == r["ids_crc32"]
