import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flockpoint.operators import assign, blocks, cells, neighbours
from flockpoint.plans.dbscan import dbscan
from flockpoint.session import attach, split_join
from flockpoint.sources import points as S

FIVE = [(1, 1), (6, 5), (6, 6), (0, 0), (1, 2)]


def skewed(seed=3):
    """A third copies of one place, a dense clump, a thin spread."""
    rng = np.random.default_rng(seed)
    x = np.vstack([np.tile([0.5, 0.5], (150, 1)), rng.normal(0.2, 0.002, (150, 2)), rng.uniform(0, 1, (150, 2))])
    return x[rng.permutation(len(x))]


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def brute_dbscan(x, eps, min_pts):
    near = distances(x) <= eps
    core = near.sum(1) >= min_pts
    label, c = -np.ones(len(x), int), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], c
            while todo:
                for k in np.nonzero(near[todo.pop()] & core)[0]:
                    if label[k] < 0:
                        label[k] = c
                        todo.append(k)
            c += 1
    for i in np.nonzero(~core)[0]:
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    return label


def test_four_points(vec):
    p = vec([(0, 1), (0, 2), (0, 4), (0, 5)])
    got = neighbours.eps_join(p.filter("id = 1"), p, 1.0).collect()
    assert sorted(r["right_id"] for r in got) == [0, 1]
    assert [r["label"] for r in dbscan(p, 1.0, 1).orderBy("id").collect()] == [0, 0, 1, 1]


def test_neighbours_without_self_and_far_core(vec):
    p = vec([(1, 1), (2, 1), (1, 4), (1, 1.5), (2, 1.5)])
    got = neighbours.eps_join(p.filter("id = 1"), p, 0.5).filter("left_id <> right_id").collect()
    assert [(r["right_id"], r["dist"]) for r in got] == [(4, 0.5)]
    assert neighbours.core_distance(p, 8, 0.5).filter("id = 0").first()["core_dist"] is None


def test_knn_graphs(vec):
    p = vec(FIVE)
    pairs = lambda g: {(r["src"], r["dst"]) for r in g.collect()}
    assert pairs(neighbours.knn_graph(p, 2)) == {(0, 4), (0, 3), (1, 2), (1, 4), (2, 4), (3, 4)}
    assert pairs(neighbours.knn_graph(p, 2, mutual=True)) == {(0, 4), (0, 3), (1, 2), (3, 4)}


def test_skewed_counts_and_neighbours(vec):
    x = skewed()
    p = vec(x.tolist())
    d = distances(x)
    ix = blocks.block_index(p, 16)
    assert ix.has_copies
    counts = {r["id"]: r["n_neigh"] for r in neighbours.neighbour_counts(ix, 0.05).collect()}
    assert [counts[i] for i in range(len(x))] == (d <= 0.05).sum(1).tolist()
    knn = neighbours.knn_join(p, 5).toPandas()
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    got = knn.sort_values(["id", "rank"]).nbr.to_numpy().reshape(len(x), 5)
    assert np.allclose(np.take_along_axis(d, got, 1), np.take_along_axis(d, want, 1))


@pytest.mark.parametrize("eps,min_pts", [(0.06, 5), (0.003, 4)])
def test_skewed_dbscan(vec, eps, min_pts):
    x = skewed()
    got = dbscan(vec(x.tolist()), eps, min_pts).orderBy("id").toPandas()
    assert got.label.tolist() == brute_dbscan(x, eps, min_pts).tolist()


def test_block_pruning_run(vec, monkeypatch):
    from flockpoint.plans import dbscan as module

    monkeypatch.setattr(module, "PRUNE_AT", 0)
    x = skewed(5)
    got = dbscan(blocks.block_index(vec(x.tolist()), 8), 0.06, 5).orderBy("id").toPandas()
    assert got.label.tolist() == brute_dbscan(x, 0.06, 5).tolist()


def test_centres_beyond_the_constant(spark, vec):
    rng = np.random.default_rng(1)
    x, c = rng.uniform(0, 1, (120, 3)), rng.uniform(0, 1, (70, 3))
    centers = vec(c.tolist()).withColumnRenamed("id", "center")
    for name in ("euclidean", "manhattan", "cosine"):
        small = assign.assign_nearest(vec(x.tolist()), centers, name, k=2)
        large = assign.assign_nearest(vec(x.tolist()), centers, name, k=2, max_values=3)
        key = lambda df: {(r["id"], r["rank"]): r["center"] for r in df.collect()}
        assert key(small) == key(large)


def test_hot_joins_keep_every_row(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    table = big.groupBy("k").agg(F.count("*").alias("w"))
    assert attach(big, table, "k", "w", hot_rows=50).count() == 1000
    left = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    right = spark.range(200).select((F.col("id") % 2).alias("k"), F.col("id").alias("b"))
    got = split_join(left, right, "k", rows=20)
    assert got.count() == left.join(right, "k").count() == got.distinct().count()


def test_points_reject_bad_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "id long, x double")
    assert S.as_points(df, "id", ["x"], on_null="drop").count() == 1
    with pytest.raises(Exception):
        S.as_points(df, "id", ["x"]).select("features").collect()
    with pytest.raises(ValueError):
        S.as_points(df, "id", ["x"], scale="odd")


def test_labels_roundtrip(spark, tmp_path):
    labels = spark.createDataFrame([(1, 6), (2, 9), (3, 6), (4, -1)], "id long, label int")
    S.write_labels(S.rebuild_labels(labels), str(tmp_path / "labels"))
    back = spark.read.parquet(str(tmp_path / "labels")).orderBy("id").collect()
    assert [r["label"] for r in back] == [1, 2, 1, -1]


def test_sums_of_near_points_are_those_of_the_pairs(vec):
    rng = np.random.default_rng(5)
    p = vec(rng.uniform(0, 1, (300, 2)))
    origin = cells.grid_origin(p)
    kept = cells.retained_cells(cells.cell_stats(p, 0.05), 4, 0.05)
    pairs = cells.near_points(p, p, kept, 0.05, origin).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    sums = cells.near_points(p, p, kept, 0.05, origin, {"n": F.lit(1), "ids": F.col("id")})
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, pairs.collect()))
    assert "features" not in sums.columns and sums.count() <= 300


def test_many_dimensions_are_searched_without_shuffling_the_table(spark, monkeypatch):
    rng = np.random.default_rng(21)
    x = rng.normal(0, 1, (700, 20))
    x[600:640] = x[:40]
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 32)
    monkeypatch.setattr(neighbours, "SCANS", 3)
    points = S.with_dim(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>"), 20)
    spread = []
    monkeypatch.setattr(neighbours, "spread_over", lambda *a: spread.append(a))
    got = {}
    for r in neighbours.knn_join(points, 4).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["nbr"], r["dist"])
    assert not spread
    for i, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        want = [int(j) for j in np.lexsort((np.arange(len(x)), d)) if j != i][:4]
        assert [got[i][r][0] for r in (1, 2, 3, 4)] == want
        assert np.allclose([got[i][r][1] for r in (1, 2, 3, 4)], d[want])


def test_other_lists_may_come_before_the_own_ones():
    rng = np.random.default_rng(22)
    x = rng.normal(0, 1, (60, 17))

    def part(ids, other):
        columns = {"g": [0], "of": [2], "other": [other], "ids": [ids], "x": [x[ids].ravel().tolist()]}
        return pa.record_batch(columns)

    parts = [part([*range(40, 60)], True), part([*range(20)], False), part([*range(20, 30)], False), part([*range(30, 40)], True)]
    out = next(neighbours._nearest_in_group(3, 17)(parts))
    d = np.sqrt(((x[:30, None] - x[None]) ** 2).sum(-1))
    d[np.arange(30), np.arange(30)] = np.inf
    assert out["nbr"].to_pylist() == np.argsort(d, axis=1, kind="stable")[:, :3].ravel().tolist()
