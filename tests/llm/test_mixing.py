import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from flockpoint.llm.mixing import mix_sources, mixed_documents, plausible_words


def plain_targets(sizes, weights, percent, most):
    """Water filling by raising one source after another to its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = sum(sizes.values()) * percent / 100, set(names), {}
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if most * sizes[s] <= weight[s] * level]
        if not above:
            return target | {s: weight[s] * level for s in free}
        for s in above:
            free.discard(s)
            target[s] = most * sizes[s]
            left -= target[s]


def plain_mix(rows, weights=(5, 2, 1), percent=150, most=2.0):
    sizes, keyed = defaultdict(int), []
    for i, text, source in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += size
        u = (int(hashlib.md5(f"{'' if i is None else i}\x1f1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        keyed.append((-math.log(u), i, size, source))
    target, out = plain_targets(sizes, weights, percent, most), []
    for s in sizes:
        rest = target[s]
        epochs = math.floor(rest / sizes[s]) if sizes[s] else 0
        rest = math.floor(rest - epochs * sizes[s])
        for _, i, size, _ in sorted((k for k in keyed if k[3] == s), key=lambda k: k[0]):
            part = max(0, min(size, rest))
            rest -= part
            out.append((i, size, target[s], epochs * size + part))
    return out


def test_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["s1", "s1", "s1", "s2", "s3", "é", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mix_sources(df, range_rows=20).collect()}
    for i, size, target, taken in plain_mix(rows):
        assert (got[i]["size"], got[i]["taken"]) == (size, taken) and abs(got[i]["target"] - target) < 1e-6
    again = {r["doc_id"]: r["taken"] for r in mix_sources(df.repartition(5), range_rows=3).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_better_texts_come_earlier(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    out = mix_sources(df, quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), percent=50)
    even, odd = (out.filter(F.col("doc_id") % 2 == k).agg(F.sum("taken")).first()[0] for k in (0, 1))
    assert even + odd == 3000 and even > 1.7 * odd


def test_edges(spark, edge, empty):
    rows = mix_sources(edge).collect()
    assert len(rows) == edge.count()
    by = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(taken - target) <= 1 for (size, target), taken in by.items())
    mixed = mixed_documents(edge)
    assert mixed.columns == edge.columns and mixed.count() > 0
    assert mix_sources(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_quality_of_texts_without_words(spark):
    rows = [(1, "", "a"), (2, " \n", "a"), (3, None, "b"), (4, "some plain words here", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in mix_sources(df, quality=plausible_words()).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (4, 6)}
    assert {r["doc_id"] for r in mixed_documents(df, quality=plausible_words()).collect()} == {1, 2, 3, 4}
