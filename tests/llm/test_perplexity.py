import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flockpoint.llm.langid import windows
from flockpoint.llm.perplexity import KneserNey, quality_rules, text_statistics, train
from flockpoint.llm.textbytes import Texts


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_statistics():
    rng = random.Random(4)
    bits = ["a", "b", "é", " ", " ", "\n", "#", "\t", "|", "\U0001f600", "\x0b"]
    texts = ["", "a", "\n\n", "a b c d e a b c d e", "x\nx\n x\nx "] + ["".join(rng.choices(bits, k=rng.randint(0, 120))) for _ in range(300)]
    got = np.stack(text_statistics(Texts(pa.array(texts, pa.large_string()))), 1)
    assert got.tolist() == [plain_statistics(t) for t in texts]


def plain_model(data, order):
    """Modified Kneser-Ney with dictionaries; returns a function of context and byte."""
    grams = {order: Counter(tuple(t[i - order + 1 : i + 1]) for t in data for i in range(order - 1, len(t)))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    drops = {}
    for k, c in grams.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        drops[k] = [0.0] + [max(0.0, min(i, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.0 for i in (1, 2, 3)]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        here = [c for g, c in grams[k].items() if g[:-1] == gram[:-1]]
        if not here:
            return p(gram[1:])
        c = grams[k][gram]
        return ((c - drops[k][min(c, 3)]) + sum(drops[k][min(x, 3)] for x in here) * p(gram[1:])) / sum(here)

    return p


def test_model_against_dictionaries():
    texts = ["abracadabra", "banana bandana", "the cat sat on the mat", "a", "aaa"]
    order = 3
    w, first, length = windows(pa.array(texts), order - 1)
    got = np.concatenate([w[a : a + n] for a, n in zip(first, length, strict=True)]).astype(np.uint64)
    keys, n = np.unique(got, return_counts=True)
    model = KneserNey(keys, n.astype(float), order)
    p = plain_model([b"\n\n" + t.encode() for t in texts], order)
    for context in (b"an", b"zz", b"\n\n", b"ca", b"az"):
        grams = np.array([context[0] << 16 | context[1] << 8 | c for c in range(256)], np.uint64)
        bits = model.bits(grams)
        assert abs(np.exp2(-bits).sum() - 1) < 1e-9
        for c in b"abnt \nz":
            assert abs(2 ** -bits[c] - p((*context, c))) < 1e-9


def test_bands_reject_what_is_unlike_the_language(spark):
    rng = random.Random(3)
    words = ["the", "cat", "house", "garden", "winter", "of", "and", "river", "stone", "summer"]
    rows = [(i, " ".join(rng.choices(words, k=60)), "en") for i in range(300)]
    odd = ["".join(chr(rng.randint(33, 126)) if rng.random() < 0.8 else " " for _ in range(400)) for _ in range(3)]
    df = spark.createDataFrame(rows + [(1000 + i, t, "en") for i, t in enumerate(odd)], "doc_id int, text string, lang string")
    gone = {r["doc_id"] for r in quality_rules(df).filter("not kept and not base_failed").collect()}
    assert gone == {1000, 1001, 1002}


@pytest.mark.parametrize("percent", [6, 10, 30])
def test_bands_hold_when_part_of_a_language_is_junk(spark, percent):
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").select("text").collect()
    rows = [(i, r["text"], "en") for i, r in enumerate(docs)]
    letters = "abcdefghijklmnopqrstuvwxyz     "
    n = len(rows) * percent // (100 - percent)
    junk = [(10_000 + i, "".join(rng.choices(letters, k=rng.randint(200, 2000))), "en") for i in range(n)]
    df = spark.createDataFrame(rows + junk, "doc_id int, text string, lang string")
    judged = quality_rules(df).filter("not base_failed").collect()
    kept = [r["doc_id"] for r in judged if r["kept"]]
    assert not [i for i in kept if i >= 10_000]
    assert len(kept) >= 0.98 * sum(r["doc_id"] < 10_000 for r in judged)


def test_edges(spark, edge, empty):
    rows = quality_rules(edge).collect()
    assert len(rows) == edge.count()
    for r in rows:
        if r["n_words"] == 0:
            assert r["base_failed"] and not r["kept"]
    assert {r["n_words"] for r in rows if r["doc_id"] == 4} == {60_001} and all(not r["kept"] for r in rows if r["doc_id"] == 4)
    assert set(train(edge.select("text", "lang"))) == {"en", "fr", None}
    assert quality_rules(empty).count() == 0
