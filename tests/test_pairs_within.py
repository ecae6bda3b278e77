import numpy as np
import pytest
from pyspark.sql import functions as F

from flockpoint.operators import forest, neighbours
from flockpoint.operators.components import component_count, connected_components


def crowded():
    """A lattice at the radius itself, a clump, copies, and rows apart."""
    rng = np.random.default_rng(6)
    grid = [(0.25 * i, 0.25 * j) for i in range(6) for j in range(6)]
    x = np.vstack([grid, rng.normal(5, 0.05, (60, 2)), np.tile([[8.0, 8.0]], (12, 1)), rng.uniform(0, 10, (40, 2))])
    return x[rng.permutation(len(x))].tolist()


@pytest.mark.parametrize("eps", [0.25])
def test_components_of_pairs_that_are_not_listed(vec, eps):
    p = vec(crowded())
    pairs = neighbours.threshold_graph(p, eps, listed=False)
    want = connected_components(p, neighbours.threshold_graph(p, eps))
    assert sorted(map(tuple, connected_components(p, pairs).collect())) == sorted(map(tuple, want.collect()))
    assert component_count(p, pairs).first()[0] == want.select("component").distinct().count()


@pytest.mark.parametrize("eps", [0.25])
def test_forest_of_pairs_that_are_not_listed(vec, eps):
    p = vec(crowded())
    listed = neighbours.pair_distances(p, eps).filter(F.col("dist") < eps).withColumnRenamed("dist", "w")
    weights = lambda f: sorted(round(r["w"], 9) for r in f.collect())
    got = forest.spanning_forest(neighbours.pair_distances(p, eps, listed=False).below(eps))
    assert weights(got) == weights(forest.spanning_forest(listed)) and 0.25 not in weights(got) or eps > 0.25
    assert connected_components(p, got).select("component").distinct().count() == p.count() - got.count()


def test_an_id_at_several_places_links_them(spark):
    p = spark.createDataFrame([(1, [0.0]), (2, [0.1]), (2, [5.0]), (3, [5.1]), (4, [9.0]), (4, [9.0])], "id long, features array<double>")
    pairs = neighbours.threshold_graph(p, 0.5, listed=False)
    ids = p.select("id").distinct()
    assert sorted(map(tuple, connected_components(ids, pairs).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert sorted(r["w"] for r in forest.spanning_forest(pairs).collect()) == pytest.approx([0.1, 0.1])
