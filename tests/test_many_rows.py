import numpy as np
import pytest
from pyspark.sql import functions as F

from flockpoint.operators import assign, cells, neighbours
from flockpoint.plans import denclue, medoids
from flockpoint.session import cut


def distances(x, y):
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))


def test_neighbours_in_many_dimensions(vec, monkeypatch):
    """No boxes: the tree would meet all blocks anyway."""
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 50)
    monkeypatch.setattr(neighbours, "walk_pairs", None)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (120, 20)), rng.normal(50, 1e-5, (40, 20)), rng.integers(0, 2, (20, 20)), np.tile(rng.normal(1, 1, 20), (9, 1))])
    x = x[rng.permutation(len(x))]
    rows = neighbours.knn_join(vec(x.tolist()), 4).toPandas().sort_values(["id", "rank"])
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert rows.nbr.to_numpy().reshape(len(x), 4).tolist() == want.tolist()
    assert np.allclose(rows.dist.to_numpy().reshape(len(x), 4), np.take_along_axis(d, want, 1), atol=1e-12)


def test_density_of_lists(vec, monkeypatch):
    monkeypatch.setattr(denclue, "LIST_ROWS", 16)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0.5, 0.05, (150, 2)), rng.uniform(0, 1, (50, 2))])
    p, s = vec(x.tolist()), 0.05
    origin = cells.grid_origin(p)
    kept = cut(cells.retained_cells(cells.cell_stats(p, s, origin), 3, s))
    data = cells.with_cell(p, s, origin).join(kept.select("cell"), "cell", "left_semi").select("cell", F.col("features").alias("p"), F.lit(2).cast("bigint").alias("w"))
    lists = denclue._cell_lists(data)
    assert lists.agg(F.max(F.size("w"))).first()[0] < 40
    got = {r["qid"]: r for r in denclue._density(p, lists, kept, s, origin, 5).collect()}
    near = cells.near_points(p, p, kept, s, origin).toPandas()
    assert set(got) == set(near.qid)
    for q, g in near.groupby("qid"):
        gap = np.array(g.features.tolist()) - x[q]
        k = 2 * np.exp(-(gap**2).sum(1) / (2 * s * s))
        assert abs(got[q]["density"] - k.sum()) < 1e-9 and np.allclose(got[q]["gradient"], (k[:, None] * gap).sum(0))


@pytest.mark.parametrize("k", [4, 1])
def test_gains_of_swaps(vec, k):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (80, 2))
    at = list(range(3, 3 + k))
    swaps = [(3, 50), (3 + k - 1, 60), (3, 61)]
    plan = [(7, [(i, x[i].tolist()) for i in at], [(gone, x[new].tolist()) for gone, new in swaps])]
    rows = vec(x.tolist()).select("features").mapInArrow(medoids._swap_gains(plan, 2), "r int, swap int, delta double")
    got = {r["swap"]: r["d"] for r in rows.groupBy("r", "swap").agg(F.sum("delta").alias("d")).collect()}
    cost = lambda m: (distances(x, x[m]) ** 2).min(1).sum()
    for s, (gone, new) in enumerate(swaps):
        assert abs(got[s] - (cost([i for i in at if i != gone] + [new]) - cost(at))) < 1e-9


def test_many_centres_as_arrays(vec):
    rng = np.random.default_rng(5)
    x, c = rng.integers(0, 9, (90, 2)).astype(float), rng.integers(0, 9, (40, 2)).astype(float)
    centers = vec(c.tolist()).withColumnRenamed("id", "center")
    out = assign.assign_nearest(vec(x.tolist()), centers, k=2)
    assert "transform" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = out.toPandas().sort_values(["id", "rank"])
    want = np.argsort(distances(x, c), axis=1, kind="stable")[:, :2]
    assert got.center.to_numpy().reshape(-1, 2).tolist() == want.tolist()
    assert got.dist.tolist() == np.take_along_axis(distances(x, c), want, 1).ravel().tolist()
