import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from flockpoint.llm import runs as module
from flockpoint.llm.queries import planted_words, run_digests
from flockpoint.llm.runs import periodic_runs, plain_runs, repair, runs_of


def slow_runs(w, least=6, power=4):
    """Straight from the definition, every stretch by its smallest period."""
    n, out = len(w), set()
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                piece = w[i : j + q]
                if not any(all(piece[k] == piece[k + d] for k in range(len(piece) - d)) for d in range(1, q)):
                    out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(rng):
    for _ in range(250):
        kind, n = rng.randint(0, 4), rng.randint(0, 90)
        if kind == 0:
            yield [rng.randint(0, 1) for _ in range(n)]
        elif kind == 1:
            yield [rng.randint(0, 40) for _ in range(n)]
        elif kind == 2:
            yield [7] * n
        else:
            out = []
            while len(out) < n:
                part = [rng.randint(0, 3) for _ in range(rng.randint(1, 7))]
                out += part * rng.randint(1, 6) + part[: rng.randint(0, len(part))] + [rng.randint(0, 9)] * rng.randint(0, 2)
            yield out


def words_of(texts):
    words = np.array([x for t in texts for x in t], np.int64)
    last = np.zeros(len(words), bool)
    ends = np.cumsum([len(t) for t in texts])
    last[[e - 1 for e, t in zip(ends, texts, strict=True) if t]] = True
    h = np.random.default_rng(1).integers(0, 1 << 63, int(words.max(initial=0)) + 1, np.uint64)
    return words, h[words], last, ends


def test_runs_against_the_definition():
    texts = list(sequences(random.Random(2)))
    texts += [texts[5], texts[5], texts[9]]  # copies share nodes
    words, h, last, ends = words_of(texts)
    start, end, p = runs_of(words, h, last, 6, 4)
    got = [[] for _ in texts]
    for a, b, q in zip(start.tolist(), end.tolist(), p.tolist(), strict=True):
        k = int(np.searchsorted(ends, a, "right"))
        got[k].append((a - int(ends[k]) + len(texts[k]), b - a, q))
    assert got == [slow_runs(t) for t in texts] and sum(map(len, got)) > 200
    for t in texts:
        assert [(a, b - a, q) for a, b, q in sorted(plain_runs(np.array(t, np.int64), 6, 4), key=lambda r: (r[0], r[2]))] == slow_runs(t)


def test_the_grammar_derives_the_words():
    texts = list(sequences(random.Random(3)))
    words, _, last, ends = words_of(texts)
    g = repair(words, last)
    for k, at in zip(g.node.tolist(), g.at.tolist(), strict=True):
        a, n = g.first[k], g.size[k]
        assert (words[at : at + n] == words[a : a + n]).all() and 0 < g.left[k] < n
        assert np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + n - 1, "right")
    whole = {(int(a), int(g.size[k])) for k, a in zip(g.node, g.at, strict=True)}
    assert all((int(e) - len(t), len(t)) in whole for e, t in zip(ends, texts, strict=True) if len(t) > 1)
    assert len(g.size) < len(g.node)  # nodes are shared


def test_wrong_hashes_change_nothing():
    texts = list(sequences(random.Random(5)))
    words, h, last, _ = words_of(texts)
    right = runs_of(words, h, last, 6, 4)
    assert np.array_equal(right, runs_of(words, np.zeros_like(h), last, 6, 4))


def test_many_nodes_in_pieces(monkeypatch):
    words, h, last, _ = words_of(list(sequences(random.Random(6))))
    right = runs_of(words, h, last, 6, 4)
    monkeypatch.setattr(module, "TESTS", 7)
    assert np.array_equal(right, runs_of(words, h, last, 6, 4))


def expected(doc_id, text):
    w = (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    w = [x for x in w if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    front = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *front, sha(told), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_plain_python(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(rng.choice("aé bc d \U0001f600 ef".split()[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "x " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = run_digests(periodic_runs(planted_words(docs)))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r[c] for c in names) for r in out.collect()) == [expected(*r) for r in rows]


def test_edges(spark, edge, empty):
    out = periodic_runs(edge).collect()
    assert len(out) == edge.count()
    by = {r["doc_id"]: r for r in out}
    assert by[2]["n_words"] == 0 and by[2]["runs"] == [] and by[2]["collapsed"] == ""
    assert by[4]["collapsed"] == "word end" and tuple(by[4]["runs"][0]) == (0, 60_000, 1)
    assert sum(r["doc_id"] is None for r in out) == 2
    assert periodic_runs(empty).count() == 0
    assert run_digests(periodic_runs(planted_words(edge))).count() == edge.count()
    with pytest.raises(ValueError):
        periodic_runs(edge, power=3)
