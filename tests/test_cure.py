import tracemalloc

import numpy as np
import pandas as pd
import pytest

from flockpoint.plans import cure as plan
from flockpoint.plans.cure import _mutual, cure


def greedy(x, k, c, alpha):
    """The closest pair by representatives merges, one at a time; labels from 0 by smallest row."""
    groups = {i: [i] for i in range(len(x))}
    reps = {i: x[i : i + 1].copy() for i in groups}
    names = np.arange(len(x))
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    dist[np.tril_indices(len(x))] = np.inf
    while len(groups) > k:
        low = dist.min(axis=1)
        u = int(np.argmin(low))
        v = int(np.argmin(dist[u]))
        groups[u] += groups.pop(v)
        pool = np.vstack([reps[u], reps.pop(v)])
        mid = x[groups[u]].mean(0)
        if len(pool) > c:
            picked = [int(np.argmax(((pool - mid) ** 2).sum(1)))]
            while len(picked) < c:
                far = sum(np.sqrt(((pool - pool[p]) ** 2).sum(1)) for p in picked)
                far[picked] = -1
                picked.append(int(np.argmax(far)))
            pool = pool[picked]
        reps[u] = pool + alpha * (mid - pool)
        dist[v, :] = dist[:, v] = np.inf
        for w in groups:
            if w != u:
                gap = np.sqrt(((reps[u][:, None] - reps[w][None]) ** 2).sum(-1)).min()
                dist[min(u, w), max(u, w)] = gap
    for label, u in enumerate(sorted(groups)):
        names[groups[u]] = label
    return names.tolist()


def moons(n, rng):
    t = rng.uniform(0, np.pi, n)
    top = np.column_stack([np.cos(t), np.sin(t)]) + rng.normal(0, 0.08, (n, 2))
    low = np.column_stack([1 - np.cos(t), 0.5 - np.sin(t)]) + rng.normal(0, 0.08, (n, 2))
    return np.vstack([top, low])


def labels_of(frame):
    return [r["label"] for r in frame.orderBy("id").collect()]


def test_phases_equal_the_greedy_merge(vec):
    rng = np.random.default_rng(21)
    x = rng.uniform(0, 1, (120, 2))
    assert labels_of(cure(vec(x.tolist()), 5, 4, 0.2, 90)[0]) == greedy(x, 5, 4, 0.2)


def test_many_rows_in_one_group(vec):
    x = moons(350, np.random.default_rng(4))
    assert labels_of(cure(vec(x.tolist()), 5, 4, 0.3)[0]) == greedy(x, 5, 4, 0.3)


def test_stop_inside_a_phase(vec):
    # far more merges are possible below the phase's distance than k allows
    x = np.random.default_rng(6).uniform(0, 1, (80, 2))
    assert labels_of(cure(vec(x.tolist()), 72, 3, 0.1, 50)[0]) == greedy(x, 72, 3, 0.1)


def test_copies(vec):
    rng = np.random.default_rng(7)
    x = np.vstack([np.repeat(rng.uniform(0, 1, (10, 2)), 4, axis=0), rng.uniform(0, 1, (30, 2))])
    assert labels_of(cure(vec(x.tolist()), 6, 3, 0.2)[0]) == greedy(x, 6, 3, 0.2)
    assert labels_of(cure(vec([(0.0, 0.0)] * 5), 2)[0]) == [0] * 5


def test_mutual_pairs(spark):
    near = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (3, 4, 0.7), (5, 6, 0.5), (6, 7, 0.5)], "src long, dst long, dist double")
    got = sorted((r["region"], r["cid"]) for r in _mutual(near).collect())
    assert got == [(2, 2), (2, 3), (5, 5), (5, 6)]


def test_a_large_region_is_merged_without_a_matrix(vec):
    n = 4_000
    x = np.random.default_rng(8).uniform(0, 1, (n, 2))
    rows = pd.DataFrame({"region": 0, "cid": np.arange(n), "n": 1, "ls": list(x), "reps": [[v] for v in x], "most": float(n - 3)})
    tracemalloc.start()
    out = plan._region_merger(4, 0.2, np.inf)((), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["cid"].nunique() == 3 and out["turn"].notna().sum() == n - 3
    assert out.loc[out["turn"].isna(), "n"].sum() == n
    assert peak < n * n * 8 / 2


def test_a_few_thousand_places_need_no_phases(vec, monkeypatch):
    monkeypatch.setattr(plan, "_near_clusters", None)
    x = np.random.default_rng(9).uniform(0, 1, (3_200, 2))
    assert cure(vec(x.tolist()), 3)[0].select("label").distinct().count() == 3


@pytest.mark.parametrize("kind", ["even", "lattice", "line", "dense spots", "nearly equal"])
def test_grid_and_dense_search_merge_alike(kind):
    rng = np.random.default_rng(12)
    x = {
        "even": rng.random((300, 2)), "lattice": rng.integers(0, 14, (300, 2)).astype(float), "line": rng.random((300, 1)),
        "dense spots": rng.normal(0, 1, (300, 3)) ** 5, "nearly equal": rng.random((100, 1)) * [[1e3, 1e-3]] + rng.integers(0, 3, (100, 1)) * 1e-15,
    }[kind]
    x = rng.permutation(np.unique(x, axis=0))
    w = rng.integers(1, 7, len(x))
    reps = [[v] * min(int(k), 4) for v, k in zip(x, w, strict=True)]
    rows = pd.DataFrame({"region": 0, "cid": np.arange(len(x)), "n": w, "ls": list(x * w[:, None]), "reps": reps})
    for below, most in ((np.inf, len(x) - 3.0), (0.3, np.inf), (np.inf, len(x) // 3)):
        here = rows.assign(most=float(most))
        grid, dense = (plan._region_merger(4, 0.2, below, n)((), here) for n in (5, 10_000))
        pd.testing.assert_frame_equal(grid, dense, check_exact=True)


def test_tens_of_thousands_of_places_are_one_region():
    n = 21_000
    assert plan.FLAT_GROUP > n > plan.GROUP
    x = np.random.default_rng(13).uniform(0, 1, (n, 2))
    rows = pd.DataFrame({"region": 0, "cid": np.arange(n), "n": 1, "ls": list(x), "reps": [[v] for v in x], "most": float(n - 4)})
    out = plan._region_merger(4, 0.3, np.inf)((), rows)
    assert out["cid"].nunique() == 4 and out.loc[out["turn"].isna(), "n"].sum() == n
