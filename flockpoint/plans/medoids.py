"""Medoid clusterings: whole-table swaps, sampled runs, and random swaps scored in batches.

Members that may replace a medoid are a table, cut down by bounds; sampled medoids and random swaps travel inside the
plan, so their rounds are one scan with a partial aggregate.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.assign import assign_nearest, best_run, summed_mean_cost
from ..session import attach, cut
from ..sources.points import dim_of, sample_key, sample_n, sample_per_run

NODES = 256  # cells of a cluster that bound a member's mean distance
PLACES = 20_000  # places of a cluster that one task tries one by one
TABLE = 1 << 20  # distances that such a task holds at a time


def _frame(points: DataFrame, rows) -> DataFrame:
    return points.sparkSession.createDataFrame(
        [(int(r[0]), [float(v) for v in r[1]]) for r in rows], "center bigint, features array<double>"
    )


def distant_start(points: DataFrame, k: int, low: float = 0.8, high: float = 0.99, seed: int = 42) -> list:
    """Starting medoids: one by hash, then rows whose distance to the nearest medoid lies in
    the quantile band ``low..high`` of the rows elsewhere, picked by hash. Returns ``[(id, features)]``.

    Rows at the place of a medoid are never chosen, so no two medoids share one; fewer than ``k`` places raise."""
    if not 0 <= low <= high < 1:
        raise ValueError("the band needs 0 <= low <= high < 1")
    first = points.orderBy(sample_key(seed), "id").select("id", "features").first()
    chosen = [(first["id"], first["features"])]
    while len(chosen) < k:
        near = assign_nearest(points, _frame(points, chosen)).select("id", "dist")
        near = near.filter(F.col("dist") > 0)
        band = near.agg(F.percentile_approx("dist", [low, high], 10_000).alias("q")).first()["q"]
        if band is None:
            raise ValueError(f"{k} medoids need as many places; there are {len(chosen)}")
        # the quantiles are distances of rows, so the band is never empty
        near = near.filter(F.col("dist").between(*band))
        pick = near.agg(F.min(F.struct(sample_key(seed + len(chosen)), "id")).alias("p")).first()["p"]
        row = points.filter(F.col("id") == pick["id"]).select("id", "features").first()
        chosen.append((row["id"], row["features"]))
    return chosen


def _scored_members(now: DataFrame, stats: DataFrame, dim: int, seed: int) -> DataFrame:
    """``now`` with the bounds ``low`` and ``high`` of a member's mean distance to its cluster.

    A cluster's box is cut into at most ``NODES`` cells. With ``n`` members about a mean ``m`` in a cell, the distances of a
    member to them sum to ``n * d(member, m)`` at least, and to that plus the cell's own distances from ``m`` at most.
    """
    dist = V.metric("euclidean", dim)
    axes = min(dim, NODES.bit_length() - 1)
    side = max(2, int(NODES ** (1 / axes) + 1e-9))
    cell = F.lit(0)
    for i in range(axes):
        f, lo, hi = F.col("features")[i], F.col("lo")[i], F.col("hi")[i]
        step = F.when(hi > lo, F.least(F.floor((f - lo) / (hi - lo) * side), F.lit(side - 1))).otherwise(F.lit(0))
        cell = cell * side + step.cast("int")
    placed = cut(attach(now, stats, "center", "n", by="id").select("id", "features", "center", cell.alias("cell")))
    nodes = placed.groupBy("center", "cell").agg(F.count(F.lit(1)).alias("w"), V.per_dim(F.avg, "features", dim).alias("m"))
    lists = nodes.groupBy("center").agg(F.collect_list(F.struct("cell", "w", "m")).alias("nodes"), F.sum("w").alias("n"))
    met = attach(placed, cut(lists), "center", "n", by="id")
    least = F.aggregate("nodes", F.lit(0.0), lambda s, x: s + x["w"] * dist(F.col("features"), x["m"])) / F.col("n")
    own = dist(F.col("features"), F.filter("nodes", lambda x: x["cell"] == F.col("cell"))[0]["m"])
    scored = cut(met.select("id", "features", "center", sample_key(seed).alias("h"), least.alias("low"), own.alias("own")))
    slack = scored.groupBy("center").agg(F.avg("own").alias("slack"))
    info = cut(stats.select("center", "n", "mean").join(slack, "center"))
    return attach(scored, info, "center", "n", by="id").select(
        "id", "features", "center", "h", "mean", "low", (F.col("low") + F.col("slack")).alias("high")
    )


def _first_better_place():
    """The function that tries the places of one cluster; made here to travel by value."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["features"].tolist(), dtype=float)
        w = rows["w"].to_numpy(dtype=float)
        # the present mean is added up like the others, so that a row at the medoid's place is no better
        mean = (rows["dist"].to_numpy() * w)[None, :].sum(axis=1)[0] / w.sum()
        first = rows["first"].to_numpy()
        order = np.lexsort((first, rows["h"].to_numpy()))
        order = order[rows["able"].to_numpy()[order]]
        step = 8
        while len(order):
            tried, order = order[:step], order[step:]
            far = np.zeros((len(tried), len(x)))
            for i in range(x.shape[1]):
                far += (x[tried, i, None] - x[None, :, i]) ** 2
            better = np.flatnonzero((np.sqrt(far) * w).sum(axis=1) / w.sum() < mean)
            if len(better):
                at = tried[better[0]]
                return pd.DataFrame({"center": key[0], "id": [int(first[at])], "features": [x[at].tolist()]})
            step = min(2 * step, max(TABLE // len(x), 1))
        return pd.DataFrame({"center": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "features": pd.Series([], dtype=object)})

    return solve


def first_better(now: DataFrame, dim: int, seed: int = 42, batch: int = 256) -> dict[int, tuple]:
    """For each cluster of ``now (id, features, center, dist)`` the first member, in hash order, whose mean distance to the
    members is below the present one: ``{center: (id, features)}``, without clusters that have none.

    Rows at one place have one mean, so places are tried, each by its first row: in one task for a cluster of up to ``PLACES`` places.
    Larger clusters are searched by rows, with bounds (``_first_better_row``).
    """
    other = F.when(F.col("id") != F.col("center"), F.struct(sample_key(seed).alias("h"), "id"))
    places = now.groupBy("center", "features").agg(F.count(F.lit(1)).alias("w"), F.min("dist").alias("dist"), F.min(other).alias("f"))
    # no nulls: numbers beside nulls would reach pandas as rounded doubles
    of = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(0).cast("bigint"))
    places = cut(places.select("center", "features", "w", "dist", F.col("f").isNotNull().alias("able"), of("h").alias("h"), of("id").alias("first")))
    sizes = {r["center"]: r["count"] for r in places.groupBy("center").count().collect()}  # one row per cluster
    large = [c for c, n in sizes.items() if n > PLACES]
    out = _first_better_row(now.filter(F.col("center").isin(large)), dim, seed, batch) if large else {}
    if len(large) < len(sizes):
        small = places.filter(~F.col("center").isin(large)) if large else places
        kinds = "center bigint, id bigint, features array<double>"
        for r in small.groupBy("center").applyInPandas(_first_better_place(), kinds).collect():  # one row per cluster
            out[r["center"]] = (r["id"], r["features"])
    return out


def _first_better_row(now: DataFrame, dim: int, seed: int = 42, batch: int = 256) -> dict[int, tuple]:
    """``first_better`` for clusters of any size.

    Bounds settle most members: those that cannot improve are dropped, the first that is sure to ends the search of its
    cluster. What lies before it is a table, and is tried exactly in hash order, about ``batch`` members of a cluster at a
    time, by a join on the split cluster. The driver sees one row per cluster.
    """
    dist = V.metric("euclidean", dim)
    stats = cut(
        now.groupBy("center").agg(
            F.count(F.lit(1)).alias("n"), F.avg("dist").alias("mean"),
            V.per_dim(F.min, "features", dim).alias("lo"), V.per_dim(F.max, "features", dim).alias("hi"),
        )
    )
    able = _scored_members(now, stats, dim, seed).filter((F.col("id") != F.col("center")) & (F.col("low") < F.col("mean") * (1 + 1e-9)))
    able = cut(able.withColumn("sure", F.col("high") < F.col("mean") * (1 - 1e-9)))
    sure = able.filter("sure").groupBy("center").agg(F.min(F.struct("h", "id", "features")).alias("stop"))
    sure = cut(sure)
    before = F.col("stop").isNull() | (F.struct("h", "id") < F.struct("stop.h", "stop.id"))
    open_ = cut(able.filter(~F.col("sure")).join(sure, "center", "left").filter(before).select("id", "features", "center", "h"))
    left = {r["center"]: r["count"] for r in open_.groupBy("center").count().collect()}
    out: dict[int, tuple] = {}
    low = dict.fromkeys(left, -(2**63) - 1)
    while left:
        spans = []
        for c, n in left.items():
            top = min(low[c] + 1 + int(2**64 * min(1.0, batch / n)), 2**63 - 1)
            spans.append((int(c), max(low[c], -(2**63)), top, low[c] < -(2**63)))
            low[c] = top
        asked = cut(now.sparkSession.createDataFrame(spans, "center bigint, above bigint, top bigint, lowest boolean"))
        fits = (F.col("lowest") | (F.col("h") > F.col("above"))) & (F.col("h") <= F.col("top"))
        tried = open_.join(asked, "center").filter(fits).groupBy("center").agg(
            F.collect_list(F.struct("h", F.col("id").alias("i"), F.col("features").alias("f"))).alias("tried")
        )
        means = (
            attach(now, cut(tried.join(stats.select("center", "n", "mean"), "center")), "center", "n", by="id")
            .select("center", "mean", "features", F.explode("tried").alias("s"))
            .groupBy("center", F.col("s.i").alias("i"))
            .agg(
                F.avg(dist(F.col("features"), F.col("s.f"))).alias("got"),
                F.first("mean").alias("mean"), F.first("s.h").alias("h"), F.first("s.f").alias("f"),
            )
        )
        best = means.filter("got < mean").groupBy("center").agg(F.min(F.struct("h", "i", "f")).alias("b"))
        for r in best.collect():  # one row per cluster
            out[r["center"]] = (r["b"]["i"], r["b"]["f"])
        left = {c: n for c, n in left.items() if c not in out and low[c] < 2**63 - 1}
    for r in sure.collect():  # one row per cluster
        out.setdefault(r["center"], (r["stop"]["id"], r["stop"]["features"]))
    return out


def kmedoids(
    points: DataFrame, k: int, max_iter: int = 10, tol: float = 0.1, low: float = 0.8, high: float = 0.99, seed: int = 42
) -> DataFrame:
    """``(id, medoid, dist)``. Within each cluster the first member, in hash order, with a lower
    mean distance becomes the medoid (``first_better``); stops when the summed means gain no more than ``tol``.
    """
    dim = dim_of(points)
    points = points.persist()
    medoids = distant_start(points, k, low, high, seed)
    best = None
    for _ in range(max_iter):
        now = cut(assign_nearest(points, _frame(points, medoids)).join(points, "id").select("id", "features", "center", "dist"))
        objective = summed_mean_cost(now).first()["objective"]
        if best is not None and not (best[0] - objective > tol):
            break
        best = (objective, now)
        swaps = first_better(now, dim, seed)
        if not swaps:
            break
        medoids = [swaps.get(m[0], m) for m in medoids]
    points.unpersist()
    return best[1].select("id", F.col("center").alias("medoid"), "dist")


def _sample_solver(k: int, metric: str, seed: int, tries: int, max_iter: int):
    """The function that finds medoids of one small sample; made here to travel by value."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        x = np.array(rows["features"].tolist(), dtype=float)
        gap = x[:, None, :] - x[None, :, :]
        if metric == "manhattan":
            d = np.abs(gap).sum(-1)
        elif metric == "cosine":
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            d = 1.0 - u @ u.T
        else:
            d = (gap**2).sum(-1)
            d = d if metric == "sqeuclidean" else np.sqrt(d)
        rng = np.random.default_rng([seed, int(key[0])])
        starts = [rng.choice(len(x), k, replace=False) for _ in range(tries)]
        cur = min(starts, key=lambda m: d[:, m].min(1).sum())
        cost = d[:, cur].min(1).sum()
        for _ in range(max_iter):
            others = np.setdiff1d(np.arange(len(x)), cur)
            trials = [
                (np.minimum(np.delete(d[:, cur], j, 1).min(1, initial=np.inf), d[:, o]).sum(), j, o)
                for j in range(k)
                for o in others
            ]
            new, j, o = min(trials)
            if not new < cost - 1e-12:
                break
            cur, cost = np.append(np.delete(cur, j), o), new
        return pd.DataFrame(
            {"run": key[0], "center": rows["id"].values[cur], "features": [list(map(float, v)) for v in x[cur]]}
        )

    return solve


def clara(
    points: DataFrame, k: int, metric: str = "sqeuclidean", runs: int = 5, max_iter: int = 100, seed: int = 42, tries: int = 17
):
    """``(assigned, costs)``: the best of several medoid sets found on samples of 40 + 2k rows.

    The samples are solved side by side; one scan of the whole table then scores all runs
    by total cost per medoid. ``assigned`` is ``(id, medoid, dist)``, ``costs`` ``(run, cost)``.
    """
    dim = dim_of(points)
    dist = V.metric(metric, dim)
    samples = sample_per_run(points, 40 + 2 * k, runs, seed)
    found = samples.groupBy("run").applyInPandas(
        _sample_solver(k, metric, seed, tries, max_iter), "run int, center bigint, features array<double>"
    )
    rows = found.collect()  # runs x k medoids
    text = json.dumps(
        [
            {"r": run, "m": [{"c": r["center"], "f": list(r["features"])} for r in rows if r["run"] == run]}
            for run in sorted({r["run"] for r in rows})
        ]
    )
    table = F.from_json(F.lit(text), "array<struct<r: int, m: array<struct<c: bigint, f: array<double>>>>>")
    near = F.transform(
        table, lambda s: F.struct(s["r"].alias("run"), F.array_min(F.transform(s["m"], lambda m: dist(F.col("features"), m["f"]))).alias("d"))
    )
    costs = points.select(F.explode(near).alias("s")).groupBy("s.run").agg((F.sum("s.d") / F.lit(k)).alias("cost"))
    costs = cut(costs)
    win = best_run(costs).first()["run"]
    chosen = [(r["center"], r["features"]) for r in rows if r["run"] == win]
    assigned = assign_nearest(points, _frame(points, chosen), metric).select("id", F.col("center").alias("medoid"), "dist")
    return assigned, costs


def _swap_gains(plan: list, dim: int):
    """Rows ``r, swap, delta``: what each swap of a restart changes in the squared cost of a task's rows; made here to travel by value.

    ``plan`` has a restart, its medoids ``(id, features)`` and its swaps ``(medoid to leave, features to come)``.
    """

    def squares(x, y):
        return sum(np.square(x[:, d] - y[d]) for d in range(dim))

    def run(batches):
        total = {r: np.zeros(len(swaps)) for r, _, swaps in plan}
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, dim)
            for r, medoids, swaps in plan:
                medoids = sorted(medoids)  # of medoids at one distance the smaller id is the nearest
                d = np.stack([squares(x, f) for _, f in medoids], axis=1)
                near = d.argmin(axis=1)
                first = d[np.arange(len(x)), near]
                second = np.partition(d, 1, axis=1)[:, 1] if len(medoids) > 1 else np.inf
                ids = np.array([c for c, _ in medoids])[near]
                for s, (gone, f) in enumerate(swaps):
                    to = squares(x, f)
                    total[r][s] += np.where(ids == gone, np.minimum(to, second) - first, np.minimum(to - first, 0.0)).sum()
        for r, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([r] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array(sums)], ["r", "swap", "delta"])

    return run


def clarans(points: DataFrame, k: int, numlocal: int = 2, maxneighbor: int = 50, batch: int = 25, seed: int = 42):
    """``(assigned, costs)``: random swaps of a medoid and a row, for several restarts at once.

    Every round draws ``batch`` swaps per restart and scores all of them in one scan, from
    the nearest and second-nearest medoid of each row; the first swap that lowers the
    squared cost is taken, ``maxneighbor`` failures in a row end a restart.
    """
    dim = dim_of(points)
    current = {
        r: [(p["id"], p["features"]) for p in sample_n(points, k, seed + 101 * r).select("id", "features").collect()]
        for r in range(numlocal)
    }
    failures = dict.fromkeys(current, 0)
    turn = 0
    while any(f < maxneighbor for f in failures.values()):
        turn += 1
        live = [r for r in current if failures[r] < maxneighbor]
        pool = sample_n(points, batch * len(live) + k, seed + 7907 * turn).select("id", "features").collect()
        plan = []
        for pos, r in enumerate(live):
            held = {m[0] for m in current[r]}
            fresh = [p for p in pool[pos * batch :] if p["id"] not in held][: min(batch, maxneighbor - failures[r])]
            swaps = [
                {"o": int(current[r][(s * 31 + turn * 17 + int(p["id"])) % k][0]), "f": list(p["features"])}
                for s, p in enumerate(fresh)
            ]
            plan.append((r, fresh, swaps))
        asked = [
            (r, [(int(m[0]), list(m[1])) for m in current[r]], [(x["o"], x["f"]) for x in swaps])
            for r, _, swaps in plan
        ]
        gains = points.select("features").mapInArrow(_swap_gains(asked, dim), "r int, swap int, delta double")
        scored = gains.groupBy("r", "swap").agg(F.sum("delta").alias("delta")).collect()  # restarts x batch rows
        for r, fresh, swaps in plan:
            tried = sorted((x["swap"], x["delta"]) for x in scored if x["r"] == r)
            win = next((s for s, delta in tried if delta < 0), None)
            if win is None:
                failures[r] += max(len(tried), 1)
                continue
            failures[r] = 0
            out = swaps[win]["o"]
            current[r] = [m if m[0] != out else (fresh[win]["id"], fresh[win]["features"]) for m in current[r]]
    costs = []
    for r, meds in current.items():
        total = assign_nearest(points, _frame(points, meds), "sqeuclidean").agg(F.sum("dist")).first()[0]
        costs.append((r, float(total)))
    win = min(costs, key=lambda c: (c[1], c[0]))[0]
    assigned = assign_nearest(points, _frame(points, current[win]), "sqeuclidean")
    table = points.sparkSession.createDataFrame(costs, "run int, cost double")
    return assigned.select("id", F.col("center").alias("medoid"), "dist"), table
