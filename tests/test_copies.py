"""Rows that share a place are rows of their own."""

import pytest
from pyspark.sql import functions as F

from flockpoint.operators import assign, features, neighbours
from flockpoint.plans import cure, medoids
from flockpoint.session import attach, split_join
from flockpoint.sources.points import sample_n


def test_pairs_of_copies(vec):
    p = vec([(0, 0), (0, 0), (1, 0), (5, 5)])
    pairs = neighbours.pair_distances(p, 1.0)
    assert sorted(map(tuple, pairs.collect())) == [(0, 1, 0.0), (0, 2, 1.0), (1, 2, 1.0)]
    assert tuple(assign.closest_pair(pairs).first()) == (0, 1, 0.0)
    assert sorted((r["id"], r["nearest"]) for r in assign.nearest_other(pairs).collect()) == [(0, 1), (1, 0), (2, 0)]
    assert sorted((r["src"], r["rank"], r["dst"]) for r in neighbours.sorted_neighbours(p, 0.5).collect()) == [
        (0, 1, 0), (0, 2, 1), (1, 1, 0), (1, 2, 1), (2, 1, 2), (3, 1, 3)
    ]
    assert sorted(map(tuple, neighbours.near_in_metric(p, 0.5).collect())) == [(0, 1)]


def test_medoids_start_at_different_places(vec):
    p = vec([(0, 0)] * 100 + [(1, 0), (2, 0), (0, 3), (4, 4)])
    start = medoids.distant_start(p, 5)
    assert len({tuple(f) for _, f in start}) == 5
    with pytest.raises(ValueError):
        medoids.distant_start(p, 6)


def test_absorbing_ends_only_when_nothing_merges(vec):
    cells = features.clustering_features(vec([(float(i),) for i in range(40)]), 1.0)
    entries = features.absorb(cells, 1.5)
    assert entries.agg(F.sum("n")).first()[0] == 40
    assert entries.count() <= 27  # left alone, a cell needs both neighbours in pairs
    again = features.absorb(entries, 1.5)
    assert again.count() == entries.count()


def test_cure_ends_for_many_clusters(vec):
    p = vec([(float(i % 17), float(i // 17)) for i in range(120)])
    labels, _ = cure.cure(p, 12, part_rows=10)
    assert labels.select("label").distinct().count() == 12


def test_samples_agree(vec):
    p = vec([(float(i),) for i in range(300)])
    assert sorted(r["id"] for r in sample_n(p, 50).collect()) == sorted(r["id"] for r in sample_n(p, 50, top_rows=10).collect())


def test_hot_keys_are_split(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("l"))
    right = spark.range(300).select(F.when(F.col("id") % 2 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    want = left.join(right, "k")
    assert split_join(left, right, "k", rows=20).exceptAll(want).isEmpty() and split_join(left, right, "k", rows=20).count() == want.count()
    table = left.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    assert attach(left, table, "k", "w", hot_rows=1).count() == 2000


def test_pair_search_by_location_agrees_with_rows(vec, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_ENTRY", 3)
    p = vec([(i % 7 * 0.3, i % 5 * 0.2) for i in range(140)] + [(9.0, 9.0), (9.05, 9.0), (20.0, 20.0)])
    for points in (p, p.unionByName(p.filter("id % 3 = 0"))):
        rows = [(r["id"], r["features"]) for r in points.collect()]
        near = [(a, b, ((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2) ** 0.5) for a, x in rows for b, y in rows]
        near = [(a, b, d) for a, b, d in near if d <= 0.25]
        lists = {}
        for a, b, d in sorted(near, key=lambda r: (r[0], r[2], r[1])):
            lists.setdefault(a, []).append((b, round(d, 9)))
        got = {}
        once = neighbours.row_pairs(points, 0.25).collect()
        assert sorted((r["src"], r["dst"]) for r in once) == sorted((a, b) for a, b, _ in near)
        for r in neighbours.sorted_neighbours(points, 0.25).orderBy("src", "rank").collect():
            got.setdefault(r["src"], []).append((r["dst"], round(r["dist"], 9)))
            assert r["rank"] == len(got[r["src"]])
        assert got == lists
        kept = neighbours.pair_distances(points, 0.25, listed=False)
        nearest = {a: min((d, b) for x, b, d in near if x == a and b != a)[1] for a in lists if any(b != a for b, _ in lists[a])}
        assert {r["id"]: r["nearest"] for r in assign.nearest_other(kept).collect()} == nearest
        assert tuple(assign.closest_pair(kept).first()) == tuple(assign.closest_pair(kept.listed()).first())


def test_ids_at_several_places_are_paired_in_full(vec):
    p = vec([(0, 0), (0.1, 0), (0.2, 0)]).withColumn("id", F.when(F.col("id") == 1, 0).otherwise(F.col("id")))
    kept = neighbours.pair_distances(p, 1.0, listed=False)
    assert kept.nearest() is None
    assert sorted((r["id"], r["nearest"]) for r in assign.nearest_other(kept).collect()) == [(0, 2), (2, 0)]


def test_neighbour_lists_shuffle_no_pairs_of_rows(vec):
    """100 rows at each of two places are 40 000 pairs; only 400 entries of lists are sorted."""
    p = vec([(0.0, 0.0), (0.1, 0.0)] * 100)
    out = neighbours.sorted_neighbours(p, 0.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 40_000
    assert plan.index("Generate explode(ids") < plan.index("Window")  # the root stands first: rows are listed after the ranking
