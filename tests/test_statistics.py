import numpy as np
import pytest
from pyspark.sql import functions as F

from flockpoint.functions import vectors as V
from flockpoint.operators import cells, density, features, summaries
from flockpoint.plans import denclue
from flockpoint.plans.cure import sample_size

ELEVEN = [(0, 0), (0, 1), (0, 2), (1, 1), (1.1, 1), (1, 2), (1, 3), (4, 5), (4, 4), (6, 4), (7, 4)]


def test_chernoff_and_unknown_names(spark):
    size = spark.range(1).select(V.chernoff_sample_size(1, 0.01, 100, 0.9).alias("n")).first()["n"]
    assert round(size, 2) == 23.03
    assert sample_size(1000, 4, f=0.1) <= 1000
    with pytest.raises(ValueError):
        V.metric("nowhere")
    with pytest.raises(ValueError):
        summaries.check_linkage("nowhere")


def test_densities_and_gradient(vec):
    at = vec([(0, 0)])
    data = vec([(1, 0), (0, 0), (2, 0)])
    assert round(density.gaussian_density(data, 1.0, at).first()["density"], 2) == 1.74
    assert density.square_wave_gradient(data, 1.0, at).first()["density"] == 2
    grad = density.gaussian_density(vec([(1, 0), (0, 2)]), 1.0, at).first()["gradient"]
    assert [round(v, 2) for v in grad] == [0.61, 0.27]


def test_cells(vec):
    p = vec([(0, 0), (0, 1), (0, 2)])
    got = {tuple(r["cell"]): (r["n"], list(r["linear_sum"])) for r in cells.cell_stats(p, 1.0).collect()}
    assert got == {(0, 0): (2, [0.0, 1.0]), (0, 1): (1, [0.0, 2.0])}
    assert cells.populated(cells.cell_stats(p, 1.0), 2).count() == 1


def test_attractor(vec):
    tops = {r["id"]: r["attractor"] for r in denclue.climb(vec(ELEVEN), 1.0, xi_c=2, delta=0.05).collect()}
    assert abs(tops[0][0] - 0.62) < 0.1 and abs(tops[0][1] - 1.34) < 0.1


def test_linkage_between_groups(vec):
    p = vec([(3, 1), (1, 7), (2, 1), (1, 1), (3, 6), (1, 3)], [0, 0, 0, 1, 1, 1])
    assert summaries.linkage_distance(p, "single").first()["dist"] == 1.0
    q = vec([(1, 1), (2, 1), (0, 1), (4, 1)], [0, 0, 1, 1])
    assert summaries.linkage_distance(q, "average").first()["dist"] == 2.0
    assert summaries.linkage_distance(q, "complete").first()["dist"] == 3.0


def test_best_ward_pair(vec):
    best = summaries.best_ward_pair(vec([(1, 2), (3, 2), (0, 0), (1, 1)], [0, 1, 2, 3])).first()
    assert (best["ci"], best["cj"], best["increment"], best["total_sse"]) == (0, 3, 0.5, 0.5)


def test_representatives(vec):
    rep = summaries.scattered_reps(vec([(0, 0), (0, 1)], [0, 0]), 1, 0.5).first()["rep"]
    assert list(rep) == [0.0, 0.25]
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (40, 2))
    got = [r["id"] for r in summaries.scattered_reps(vec(x.tolist(), [0] * 40), 4, 0.2).orderBy("rank").collect()]
    want = [int(np.argmax(((x - x.mean(0)) ** 2).sum(1)))]
    while len(want) < 4:
        far = np.sqrt(((x[:, None] - x[want][None]) ** 2).sum(-1)).sum(1)
        far[want] = -1
        want.append(int(np.argmax(far)))
    assert got == want


def test_features_add_up_and_shrink(vec):
    rng = np.random.default_rng(4)
    p = vec(rng.uniform(0, 1, (200, 2)).tolist())
    cfs, reached = features.grow_threshold(p, 0.05, max_entries=30)
    assert cfs.count() <= 30 and reached > 0.05
    assert cfs.agg(F.sum("n")).first()[0] == 200
    assert cfs.filter(V.cf_diameter("n", "ls", "ss") > reached + 1e-9).count() == 0
