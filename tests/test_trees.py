import numpy as np
import pytest
from pyspark.sql import functions as F

from flockpoint.operators import forest, graphs, neighbours
from flockpoint.operators.bisection import bisect, partition_graph
from flockpoint.operators.components import connected_components
from flockpoint.plans import agglomerative, chameleon, cure, medoids, reachability

NINE = [(0, 0), (0, 1), (3, 3), (0, 2), (1, 1), (3, 5), (3, 4), (1, 2), (1, 3)]


def greedy_heights(x, linkage):
    groups, out = [[i] for i in range(len(x))], []
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def gap(a, b):
        if linkage == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        block = d[np.ix_(a, b)]
        return {"single": block.min(), "complete": block.max(), "average": block.mean()}[linkage]

    while len(groups) > 1:
        h, i, j = min((gap(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        out.append(h)
        groups[i] += groups.pop(j)
    return out


def test_reachability_and_flat_clusters(vec):
    h = reachability.density_hierarchy(vec(NINE), 2, 4.0)
    rows = reachability.reachability(h).collect()
    assert sorted(r["reach_dist"] or -1 for r in rows) == [-1] + [1.0] * 7 + [2.0]
    assert {r["core_dist"] for r in rows} == {1.0}
    h = reachability.density_hierarchy(vec([(0, 0), (0, 1), (1, 0), (3, 3), (3, 4), (3, 3.5)]), 2, 1.5)
    assert [r["label"] for r in reachability.extract_clusters(h, 1.0).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1]


def test_forest_against_prim(vec):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 0.05, (60, 2)), rng.normal(2, 0.4, (60, 2))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, 3]
    m = np.maximum(np.maximum(core[:, None], core[None]), d)
    seen, best, want = {0}, m[0].copy(), 0.0
    while len(seen) < len(x):
        best[list(seen)] = np.inf
        i = int(np.argmin(best))
        want += best[i]
        seen.add(i)
        best = np.minimum(best, m[i])
    h = reachability.density_hierarchy(vec(x.tolist()), 4)
    got = h.forest.agg(F.sum("w"), F.count("*")).first()
    assert got[1] == 119 and abs(got[0] - want) < 1e-9


def test_merge_table_in_pieces(vec):
    rng = np.random.default_rng(8)
    p = vec(rng.uniform(0, 1, (40, 2)).tolist())
    ix = neighbours.knn_index(p, 8)
    verts = ix.points.select(F.col("pid").alias("id"), "w")
    pairs = neighbours.pair_distances(ix, 2.0).withColumnRenamed("dist", "w")
    tree = forest.spanning_forest(pairs)
    whole = forest.merge_table(verts, tree).orderBy("step").collect()
    parts = forest.merge_table(verts, tree, chunk_edges=12).orderBy("step").collect()
    assert whole == parts and len(whole) == 39


def plain_merges(n, edges):
    """Single-linkage merges of a tree, edge by edge."""
    low, size, made, up = list(range(n)), [1] * n, [0] * n, list(range(n))
    find = lambda i: i if up[i] == i else find(up[i])
    out = []
    for step, (a, b, w) in enumerate(sorted(edges, key=lambda e: (e[2], e[0], e[1])), 1):
        x, y = sorted((find(a), find(b)), key=lambda r: low[r])
        out.append((step, low[x], low[y], made[x], made[y], w, size[x] + size[y]))
        up[y], size[x], made[x] = x, size[x] + size[y], step
    return out


@pytest.mark.parametrize("shape,chunk", [("path", 4), ("star", 3), ("mixed", 5)])
def test_merge_table_of_both_halves(spark, shape, chunk):
    # both halves of the forest stay large, so names must be told apart between pieces
    n = 33
    rng = np.random.default_rng(5)
    ends = {"path": lambda i: i - 1, "star": lambda i: 0, "mixed": lambda i: int(rng.integers(max(0, i - 6), i))}[shape]
    edges = [(ends(i), i, float(i if shape == "path" else rng.integers(1, 99))) for i in range(1, n)]
    tree = spark.createDataFrame(edges, "src bigint, dst bigint, w double")
    verts = spark.range(n).select("id", F.lit(1).cast("bigint").alias("w"))
    got = forest.merge_table(verts, tree, chunk_edges=chunk).orderBy("step").collect()
    assert [tuple(r) for r in got] == plain_merges(n, edges)


def test_many_merges_need_no_split(spark, monkeypatch):
    monkeypatch.setattr(forest, "connected_components", None)
    n = 30_000
    tree = spark.range(1, n).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"), F.col("id").cast("double").alias("w"))
    verts = spark.range(n).select("id", F.lit(1).cast("bigint").alias("w"))
    got = forest.merge_table(verts, tree)
    want = spark.range(1, n).select(
        F.col("id").alias("step"), F.lit(0).cast("bigint").alias("left"), F.col("id").alias("right"), (F.col("id") - 1).alias("left_step"),
        F.lit(0).cast("bigint").alias("right_step"), F.col("id").cast("double").alias("height"), (F.col("id") + 1).alias("size"),
    )
    assert got.count() == n - 1 and got.exceptAll(want).isEmpty()


@pytest.mark.parametrize("linkage", ["average", "ward"])
def test_agglomeration_against_greedy(vec, linkage):
    x = np.random.default_rng(9).uniform(0, 1, (18, 2))
    rows = agglomerative.agglomerate(vec(x.tolist()), linkage).orderBy("step").collect()
    assert np.allclose([r["height"] for r in rows], greedy_heights(x, linkage))
    assert rows[-1]["size"] == 18


@pytest.mark.parametrize("linkage", ["complete", "average"])
def test_linkage_beyond_the_pair_table(vec, monkeypatch, linkage):
    monkeypatch.setattr(agglomerative, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(0, 1, (40, 2)), rng.normal(6, 0.2, (25, 2)), [[40.0, 40.0]]])
    x = np.concatenate([x, x[[3, 3, 50]]])  # copies of a place are one leaf
    tree = lambda **how: agglomerative.agglomerate(vec(x.tolist()), linkage, **how).orderBy("step").collect()
    whole, rounds = tree(), tree(pair_rows=10, finish=30)
    bare = lambda rows: [tuple(r)[:5] + (r["size"],) for r in rows]
    assert bare(rounds) == bare(whole)
    assert np.allclose([r["height"] for r in rounds], greedy_heights(x, linkage)[3:])


def test_ward_rounds_over_blocks(vec):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (50, 2)), rng.normal(6, 0.2, (35, 2)), [[40.0, 40.0]]])
    x = np.concatenate([x, x[[3, 3, 60]]])  # copies of a place are one leaf
    tree = lambda **how: agglomerative.agglomerate(vec(x.tolist()), "ward", **how).orderBy("step").collect()
    rounds, last = tree(finish=20), tree()
    assert [tuple(r)[:5] + (r["size"],) for r in rounds] == [tuple(r)[:5] + (r["size"],) for r in last]
    heights = greedy_heights(x, "ward")
    assert heights[:3] == [0, 0, 0] and np.allclose([r["height"] for r in rounds], heights[3:])
    assert np.allclose([r["height"] for r in last], heights[3:]) and rounds[-1]["size"] == len(x)


def test_ward_ties_go_to_smaller_ids(vec):
    rows = agglomerative.agglomerate(vec([(0,), (1,), (2,), (3,), (10,)]), "ward").orderBy("step").collect()
    assert [(r["left"], r["right"], r["left_step"], r["right_step"]) for r in rows] == [(0, 1, 0, 0), (2, 3, 0, 0), (0, 2, 1, 2), (0, 4, 3, 0)]
    rounds = agglomerative.agglomerate(vec([(0,), (1,), (2,), (3,), (10,)]), "ward", finish=1).orderBy("step").collect()
    assert rounds == rows


def test_components_of_mutual_graph(vec):
    p = vec([(1, 1), (6, 5), (6, 6), (0, 0), (1, 2), (2, 1), (5, 5), (7, 6)])
    comps = connected_components(p, neighbours.knn_graph(p, 3, mutual=True)).collect()
    groups = {}
    for r in comps:
        groups.setdefault(r["component"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[0, 3, 4, 5], [1, 2, 6, 7]]


def test_two_parts(vec):
    p = vec([(1, 1), (6, 5), (6, 6), (0, 0), (1, 2), (5, 5), (7, 2)])
    edges = neighbours.knn_graph(p, 3)
    rows = partition_graph(p, edges, 2, chameleon._guess(p)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["label"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[0, 3, 4], [1, 2, 5, 6]]


def test_second_graph_version(vec):
    labels, scores = chameleon.chameleon2(vec([(1, 1), (2, 2), (2, 1), (0, 0), (1, 2), (1, 3), (10, 10), (11, 11)]), m=2)
    sizes = sorted(r["count"] for r in labels.groupBy("label").count().collect())
    assert sizes == [2, 6]


def test_cure_five_points(vec):
    labels, reps = cure.cure(vec([(0, 0), (0, 1), (0, 2), (1, 2), (1, 3)]), 2, c=3, alpha=0.1)
    assert [r["label"] for r in labels.orderBy("id").collect()] == [0, 0, 1, 1, 1]
    got = sorted(tuple(round(v, 4) for v in r["rep"]) for r in reps.collect())
    assert got == sorted([(0.0, 0.05), (0.0, 0.95), (0.9667, 2.9333), (0.1117, 2.0333), (0.9217, 2.0333)])


def test_cure_keeps_all_rows(vec):
    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    labels, _ = cure.cure(vec(x.tolist()), 3)
    rows = labels.orderBy("id").toPandas()
    assert len(rows) == 90 and rows.label.tolist() == [0] * 30 + [1] * 30 + [2] * 30


def test_medoids_find_three_groups(vec):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, 0.2, (30, 2)) for c in (0, 5, 10)])
    p = vec(x.tolist())
    for got in (medoids.clara(p, 3, runs=2)[0], medoids.clarans(p, 3, numlocal=1, maxneighbor=30)[0]):
        rows = got.orderBy("id").toPandas()
        assert [rows.medoid[i : i + 30].nunique() for i in (0, 30, 60)] == [1, 1, 1] and rows.medoid.nunique() == 3
    best = medoids.kmedoids(p, 3, tol=0.0)
    assert best.count() == 90 and best.agg(F.countDistinct("medoid")).first()[0] <= 3


def test_stable_clusters_of_two_blobs(vec):
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(0, 0.1, (25, 2)), rng.normal(4, 0.1, (25, 2)), [[2, 9.0]]])
    labels, tree = reachability.stable_clusters(vec(x.tolist()), 8)
    rows = labels.orderBy("id").toPandas()
    assert rows.label[:25].mode()[0] != rows.label[25:50].mode()[0] and rows.label[50] == -1
    assert rows.outlier_score.between(0, 1).all() and tree.filter("chosen").count() == 2


def test_line_forest_is_the_gaps(vec, monkeypatch):
    """On a line the box tree is not walked: the steps between neighbours are the forest."""
    monkeypatch.setattr(forest, "_shorter_edges", None)
    x = np.unique(np.random.default_rng(11).integers(0, 100_000, 500))
    ix = neighbours.knn_index(vec([(v,) for v in np.random.default_rng(12).permutation(x)]), 4)
    zero = ix.points.select("pid", F.lit(0.0).alias("core_dist"))
    got = [r["w"] for r in forest.reach_forest(ix, zero, neighbours.location_knn(ix, 4)).orderBy("w").collect()]
    assert got == sorted(np.diff(x).astype(float))
    few = forest.reach_forest(ix, zero, neighbours.location_knn(ix, 4), 100.0)
    assert few.count() == (np.diff(x) <= 100).sum()


def test_forest_from_many_small_ranges(vec, monkeypatch):
    monkeypatch.setattr(forest, "CONTRACT_PLACES", 20)
    test_forest_against_prim(vec)


def test_condensed_tree_in_one_task_or_by_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(10 * i, None if i in (0, 1) else 10 * int(rng.integers(0, i)), float(rng.integers(0, 50)), float(rng.integers(0, 90))) for i in range(80)]
    tree = spark.createDataFrame(rows, "cluster bigint, parent bigint, stability double, death double")
    with monkeypatch.context() as m:
        m.setattr(reachability, "_choose", None)  # not by a round a level
        top, deep = (sorted(map(tuple, t.collect())) for t in reachability._picked(tree))
    assert top == sorted(map(tuple, reachability._tops(tree, reachability._choose(tree)).collect()))
    assert deep == sorted(map(tuple, reachability._deepest(tree).collect()))


def test_vertices_are_not_sent_through_the_driver(spark):
    """Tables of one row per vertex meet the edges by shuffles, whatever their size."""
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src long, dst long, weight double")
    labels = spark.createDataFrame([(i, 0) for i in range(3)], "id long, label int")
    for df in (graphs.label_edges(edges, labels), graphs.edge_stats(edges, labels)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_bisection_against_the_plain_walk(spark):
    rng = np.random.default_rng(9)
    n = 60
    ends = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (150, 2)).tolist() if a != b})
    weight, guess = rng.uniform(0.5, 2, len(ends)), rng.uniform(-1, 1, n)
    edges = spark.createDataFrame([(a, b, float(w)) for (a, b), w in zip(ends, weight)], "src long, dst long, weight double")
    start = spark.createDataFrame([(i, float(x)) for i, x in enumerate(guess)], "id long, x double")
    w = np.zeros((n, n))
    for (a, b), v in zip(ends, weight):
        w[a, b] = w[b, a] = v
    g = w.sum(1)
    move = np.where(g[:, None] > 0, w / np.maximum(g[:, None], 1e-9) / 2, 0) + np.diag(np.where(g > 0, 0.5, 1.0))
    x = guess - (g * guess).sum() / g.sum()
    for _ in range(12):
        x = move @ x
    got = bisect(spark.range(n).withColumn("label", F.lit(0)), edges, start).collect()
    assert {r["id"]: r["side"] for r in got} == {i: int(v >= np.sort(x)[n // 2 - 1]) for i, v in enumerate(x)}
