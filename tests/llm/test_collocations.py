import random
import re
from collections import Counter, defaultdict

import numpy as np

from flockpoint.llm.collocations import Container, HatTrie, Node, collocations

SPACE = re.compile(r"[^\x20\x09]+")


def plain(rows, least, longest, top):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = SPACE.findall(piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        inside = defaultdict(int)
        for g, a in found.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        ranked = []
        for g, a in found.items():
            if inside[g] >= a:
                continue
            score, _, l, r = min((1000 * a * total[lang] // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), l, r))
        for i, (s, a, g, l, r) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, g.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def texts(rng, n):
    words = ["the", "The", "of", "new", "york", "été", "ÉTÉ", "a|b", "x", "\U0001f600", "city"]
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choice(["new york city", "of the", *words, rng.choice(words) + rng.choice(".,;:!?\n\r\x0b"), "w" + str(rng.randint(0, 40))]))
        yield rng.choice(["en", "en", "fr", None, "und", ""]), rng.choice([" ", "  ", "\t"]).join(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_against_plain_python(spark):
    rows = list(texts(random.Random(1), 400)) + [("en", None), (None, None), ("de", ""), ("de", "a b " * 50), ("xx", "... ,,")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for least, longest, top, room, burst in ((4, 5, 2000, 400_000, 8192), (4, 5, 25, 50, 3), (2, 2, 2000, 300, 1), (3, 7, 2000, 1000, 2)):
        got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations(docs, least=least, longest=longest, top=top, room=room, burst=burst).collect())
        assert got == plain(rows, least, longest, top), (least, longest)
    assert len(got) > 100


def test_exact_beyond_64_bits(spark):
    docs = spark.createDataFrame([("en", "a b " * 40_000 + "c " * 30_000)], "lang string, text string")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations(docs, least=10_000).collect())
    assert got == plain([("en", "a b " * 40_000 + "c " * 30_000)], 10_000, 5, 2000)
    top = spark.range(1).selectExpr(
        "(cast(1000 as decimal(4,0)) * cast(9000000000000 as decimal(17,0)) * cast(90000000000000 as decimal(17,0))) div (cast(9000000000001 as decimal(19,0)) * cast(9000000000007 as decimal(19,0))) s"
    )
    assert top.collect()[0]["s"] == 1000 * 9000000000000 * 90000000000000 // (9000000000001 * 9000000000007)


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(3)
    want = Counter()
    trie = HatTrie(3, burst=4)
    runs = []
    for _ in range(30):
        rows = rng.integers(0, 6, (200, 3)).astype(np.uint64)
        rows[:, 0] += np.uint64(1)
        rows, counts = np.unique(rows, axis=0, return_counts=True)
        want.update({tuple(r): int(c) for r, c in zip(rows.tolist(), counts, strict=True)})
        trie.add(rows, counts)
        assert trie.size == sum(trie.keys.values())
        if trie.size > 150:
            before = set(trie.root)
            part = list(trie.spill(75))
            assert trie.size <= 75
            gone = {int(r[0]) for rows, _ in part for r in rows}
            assert gone == before - set(trie.root)  # whole subtrees
            assert all((np.lexsort(rows.T[::-1]) == np.arange(len(rows))).all() for rows, _ in part)
            runs += part
    assert any(type(b) is Node and all(type(k) in (Node, Container) for k in b.values()) for b in trie.root.values())
    runs += list(trie.spill(0))
    assert trie.size == 0 and not trie.root
    got = Counter()
    for rows, counts in runs:
        got.update({tuple(r): int(c) for r, c in zip(rows.tolist(), counts, strict=True)})
    assert got == want


def test_edges(spark, edge, empty):
    assert collocations(empty).count() == 0
    clash = edge.withColumnRenamed("n", "words").withColumnRenamed("id", "left").withColumnRenamed("region", "a")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations(clash, least=3).collect())
    assert got == plain([(r["lang"], r["text"]) for r in edge.collect()], 3, 5, 2000)
    assert ("en", 1) in {(g[0], g[1]) for g in got} and any(g[2] == "word word word word word" for g in got)
