import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockpoint.plans import medoids
from flockpoint.sources.points import sample_key


def plain(now, seed):
    """The first better member of every cluster by trying all of them in hash order."""
    rows = now.withColumn("h", sample_key(seed)).collect()
    out = {}
    for c in {r["center"] for r in rows}:
        mine = sorted((r for r in rows if r["center"] == c), key=lambda r: (r["h"], r["id"]))
        x = np.array([r["features"] for r in mine])
        mean = np.mean([r["dist"] for r in mine])
        for r in mine:
            if r["id"] != c and np.sqrt(((x - r["features"]) ** 2).sum(1)).mean() < mean - 1e-12:
                out[c] = r["id"]
                break
    return out


def assigned(spark, rng, dim, sizes, rank):
    """Clusters whose medoid is their member of the given rank by mean distance."""
    rows, at = [], 0
    for s, size in enumerate(sizes):
        x = np.array([[rng.gauss(9 * s, 1) for _ in range(dim)] for _ in range(size)])
        cost = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).mean(1)
        m = int(np.argsort(cost)[min(rank, size - 1)])
        rows += [(at + i, [float(v) for v in x[i]], at + m, float(np.sqrt(((x[i] - x[m]) ** 2).sum()))) for i in range(size)]
        at += size
    return spark.createDataFrame(rows, "id long, features array<double>, center long, dist double")


@pytest.mark.parametrize(("dim", "rank", "batch"), [(2, 3, 4), (2, 200, 256), (10, 5, 64)])
def test_first_better_against_all_members(spark, dim, rank, batch):
    now = assigned(spark, random.Random(dim + rank), dim, [400, 60, 1], rank)
    got = medoids.first_better(now, dim, 7, batch)
    assert {c: v[0] for c, v in got.items()} == plain(now, 7)


def test_bounds_hold_and_settle_members(spark):
    now = assigned(spark, random.Random(3), 2, [500, 80], 250)
    stats = now.groupBy("center").agg(
        F.count("*").alias("n"), F.avg("dist").alias("mean"),
        F.array(F.min(F.col("features")[0]), F.min(F.col("features")[1])).alias("lo"),
        F.array(F.max(F.col("features")[0]), F.max(F.col("features")[1])).alias("hi"),
    )
    rows = medoids._scored_members(now, stats, 2, 7).collect()
    of = {c: np.array([r["features"] for r in rows if r["center"] == c]) for c in {r["center"] for r in rows}}
    for r in rows:
        true = np.sqrt(((of[r["center"]] - r["features"]) ** 2).sum(1)).mean()
        assert r["low"] <= true + 1e-9 and true <= r["high"] + 1e-9
    assert sum(r["high"] < r["mean"] or r["low"] >= r["mean"] for r in rows) > 0.8 * len(rows)


def test_copies_and_a_best_medoid(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 0, 0.0) for i in range(30)], "id long, features array<double>, center long, dist double")
    assert medoids.first_better(same, 2) == {}
    now = assigned(spark, random.Random(5), 2, [120, 90], 0)
    assert medoids.first_better(now, 2) == {}


def test_places_are_tried_in_one_task_and_like_rows(spark, monkeypatch):
    now = assigned(spark, random.Random(11), 2, [150, 80], 40)
    copies = now.select((F.col("id") + 10_000).alias("id"), "features", "center", "dist").filter("id % 3 = 0")
    now = now.unionByName(copies).unionByName(now.filter("id % 7 = 0"))
    rows = medoids._first_better_row(now, 2, 7)
    assert {c: v[0] for c, v in rows.items()} == plain(now, 7)
    monkeypatch.setattr(medoids, "PLACES", 100)
    mixed = medoids.first_better(now, 2, 7)  # one cluster by places, one by rows
    monkeypatch.setattr(medoids, "PLACES", 1_000)
    monkeypatch.setattr(medoids, "_scored_members", None)
    places = medoids.first_better(now, 2, 7)
    assert {c: (v[0], list(v[1])) for c, v in places.items()} == {c: (v[0], list(v[1])) for c, v in rows.items()}
    assert {c: v[0] for c, v in mixed.items()} == {c: v[0] for c, v in rows.items()}
