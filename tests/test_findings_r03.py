"""Faults that a reviewer found in round 3, each with a test that failed before."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajecta import registry
from trajecta.operators import grouped, kernels, maps, paths, preprocess, tables


def test_rounding_agrees_with_sql(spark):
    values = [2055.7537445, 2128.0312375, -2055.7537445, 0.5e-6, -0.5e-6, 1.5e-6, 12.3125, 0.0, 1e300, 1e308, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(registry.rounded(F.col("v"), 6)).collect()]
    want = [duckdb.execute("select round(cast(? as double), 6)", [v]).fetchone()[0] for v in values]
    assert got == want


def test_equal_means_neither_fall_nor_rise():
    # the mean of two equal sizes is that size, whatever came before
    v = np.array([0.1, 0.7, 0.3, 0.9, 0.34776, 0.34776, 0.2, np.nan, 0.5])
    means = kernels.forward_means(v, np.arange(9.0), 2.0)
    assert means[4] == v[4] and means[5] == (v[5] + v[6]) / 2 and np.isnan(means[7]) and means[8] == 0.5
    r = np.random.default_rng(3)
    v, t = r.random(200), np.cumsum(r.random(200))
    v[r.random(200) < 0.1] = np.nan
    got = kernels.forward_means(v, t, 3.0)
    for k in range(1, 200):
        if not np.isnan(v[k]):
            stop = next((j for j in range(k + 1, 200) if np.isnan(v[j]) or t[j] > t[k - 1] + 3.0), 200)
            assert abs(got[k] - v[k:stop].mean()) < 1e-12


def test_quantile_states_agree_with_sql():
    # of 91 values the seventh decile is one of them
    r = np.random.default_rng(4)
    con = duckdb.connect()
    for n in [91] * 40 + [45, 60, 67, 99]:
        v = np.round(r.exponential(50, n), 2) / 500
        con.register("f", pd.DataFrame({"v": v}))
        edges = con.execute("select quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) from f").fetchall()[0][0]
        assert np.searchsorted(kernels.quantile_edges(v, 10), v).tolist() == np.searchsorted(edges, v).tolist()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kde_heatmap_broadcasts_no_grid(spark):
    rows = pd.DataFrame({"user_id": [1] * 5 + [2] * 4 + [3] * 2, "x": [0.1, 0.5, 0.3, 0.9, 0.2, 0.3, 0.4, 0.8, 0.1, 0.5, 0.6], "y": [0.2, 0.1, 0.7, 0.6, 0.5, 0.1, 0.9, 0.3, 0.3, 0.2, 0.4]})
    made = maps.kde_heatmap(spark.createDataFrame(rows), registry.R, 4)
    assert "Broadcast" not in plan(made) and plan(made).count("Exchange hashpartitioning") == 1
    got = {(r["user_id"], r["i"], r["j"]): r["v"] for r in made.collect()}
    assert {k[0] for k in got} == {1, 2} and len(got) == 32
    for k, part in rows[rows["user_id"] < 3].groupby("user_id"):
        grid = np.linspace(0, 1, 4)
        want = kernels.kde(part["x"].to_numpy(), part["y"].to_numpy(), grid, grid)
        assert all(abs(got[k, i, j] - want[i, j]) < 1e-9 for i in range(4) for j in range(4))


def made_paths(n, seed=5):
    r = np.random.default_rng(seed)
    rows = [(i, t, float(t), x, y, 100.0) for i in range(n) for t, (x, y) in enumerate(r.random((int(r.integers(1, 6)), 2)).tolist())]
    return pd.DataFrame(rows, columns=["user_id", "event_id", "t", "x", "y", "duration"])


def plain_matrix(rows, measure):
    paths = {str(k): part[["x", "y", "duration"]].to_numpy() for k, part in rows.groupby("user_id")}
    names = sorted(paths)
    return names, np.array([[measure(*[paths[k] for k in sorted((a, b))]) for b in names] for a in names])


def test_tables_of_pairs(spark):
    rows = made_paths(30)
    df = spark.createDataFrame(rows)
    names, want = plain_matrix(rows, lambda a, b: kernels.path_distance("euc", a, b))
    for block in (7, 1024):
        got = tables.pairwise(df, registry.R, None, table=kernels.step_table, block=block)
        assert "Exchange hashpartitioning(p" not in plan(got)
        found, m = tables.collect_matrix(got)
        assert found == names and got.count() == 900 and np.allclose(m, want, atol=1e-12)
        packed = tables.collect_pairs(df, registry.R, None, table=kernels.step_table, block=block)
        assert packed[0] == names and np.allclose(packed[1], want, atol=1e-12)
        centred = tables.pairwise(df, registry.R, None, table=kernels.step_table, block=block, centred=True)
        # the pairs themselves go through one exchange only, that of the blocks
        assert "Window [avg" not in plan(centred) and np.allclose(tables.collect_matrix(centred)[1], kernels.double_centre(want), atol=1e-12)
        alike = tables.pairwise(df, registry.R, None, similarity=True, table=lambda a, b: 3 / (1 + kernels.step_table(a, b)), block=block)
        near = np.where(np.eye(30, dtype=bool), 1, 3 / (1 + want))
        assert np.allclose(tables.collect_matrix(alike)[1], (near + 1) / (near.max() + 1), atol=1e-12)
    assert "Window [avg" not in plan(tables.double_centred(got)) and np.allclose(tables.collect_matrix(tables.double_centred(got))[1], kernels.double_centre(want))


def test_rv_without_pairs(spark):
    rows = made_paths(40, 6)
    a, b = (kernels.double_centre(plain_matrix(rows, lambda p, q, m=m: kernels.path_distance(m, p, q))[1]) for m in ("euc", "tde"))
    assert abs(tables.rv_of(spark.createDataFrame(rows), registry.R, (kernels.step_factors, kernels.mean_factors)) - kernels.rv(a, b)) < 1e-9


def test_orders_of_many_rows(spark, monkeypatch):
    rows = spark.range(5001).selectExpr("cast(id as string) p", "cast(id as string) q", "1.0D value")
    assert len(tables.collect_matrix(rows)[0]) == 5001  # 5,000 was the limit
    r = np.random.default_rng(7)
    points = r.random((300, 2))
    apart = np.linalg.norm(points[:, None] - points[None], axis=2)
    near = np.exp(-apart)
    want = kernels.mds_order(apart), kernels.spectral_order(near)
    monkeypatch.setattr(kernels, "DENSE", 10)
    for a, b in zip((kernels.mds_order(apart), kernels.spectral_order(near)), want, strict=True):
        assert a.tolist() in (b.tolist(), b[::-1].tolist())


@pytest.mark.parametrize("optimal", [False, True])
@pytest.mark.parametrize("n", [1, 2, 30, 420])
def test_ward_order_by_nearest_rows(n, optimal):
    rows = np.round(np.random.default_rng(n).random((n, 3)), 1 if n == 30 else 9)
    d = np.linalg.norm(rows[:, None] - rows[None], axis=2)
    cost, size, leaves = d**2 / 2, np.ones(n), {i: [i] for i in range(n)}
    np.fill_diagonal(cost, np.inf)
    for _ in range(n - 1):  # the plain way: look at every pair each time
        a, b = map(int, np.unravel_index(int(cost.argmin()), cost.shape))
        a, b = min(a, b), max(a, b)
        la, lb = leaves[a], leaves.pop(b)
        turns = [(la, lb), (la, lb[::-1]), (la[::-1], lb), (la[::-1], lb[::-1])] if optimal else [(la, lb)]
        left, right = min(turns, key=lambda e: d[e[0][-1], e[1][0]])
        leaves[a] = left + right
        merged = ((size[a] + size) * cost[a] + (size[b] + size) * cost[b] - size * cost[a, b]) / (size[a] + size[b] + size)
        cost[a], cost[:, a] = merged, merged
        cost[a, a] = np.inf
        cost[b], cost[:, b] = np.inf, np.inf
        size[a] += size[b]
    assert kernels.ward_order(rows, optimal) == next(iter(leaves.values()))


def test_trajectories_of_sorted_batches():
    key = np.repeat([1, 2, 3, 4, 5], [3, 1, 7, 2, 4])
    table = pd.DataFrame({"k": key, "v": np.arange(len(key))})
    for size in (1, 2, 3, 5, 100):
        got = list(grouped.trajectories((table.iloc[a : a + size] for a in range(0, len(table), size)), ["k"]))
        assert [g["k"].iloc[0] for g, _ in got] == [1, 2, 3, 4, 5] and got[-1][1]
        assert np.concatenate([g["v"].to_numpy() for g, _ in got]).tolist() == list(range(len(key)))
        assert all(g.index.tolist() == list(range(len(g))) and g["k"].nunique() == 1 for g, _ in got)


def test_many_trajectories_share_a_batch(spark):
    df = spark.createDataFrame(made_paths(40, 8))
    kernel = grouped.run_kernels(df, registry.R, [grouped.Kernel(["n"], lambda x, y, t, p: [len(x)])])
    assert "MapInPandas" in plan(kernel) and "FlatMapGroups" not in plan(kernel)
    assert {r["user_id"]: r["n"] for r in kernel.collect()} == {r["user_id"]: r["count"] for r in df.groupBy("user_id").count().collect()}
    circles = preprocess.enclosing_circles(df.withColumn("fixation_id", (F.col("event_id") / 2).cast("int")), registry.R)
    assert "MapInPandas" in plan(circles) and "hashpartitioning(user_id#" in plan(circles)
    rows = made_paths(40, 8)
    want = {k: 2 * kernels.enclosing_circle(part[["x", "y"]].to_numpy())[2] for k, part in rows.groupby(["user_id", rows["event_id"] // 2])}
    assert {(r["user_id"], r["fixation_id"]): r["diameters"] for r in circles.collect()} == want


def test_fast_kernels_agree_with_plain_ones():
    r = np.random.default_rng(11)
    for n in (2, 3, 8, 40, 67):
        x, y = np.round(r.random(n), 2), np.round(r.random(n), 2)
        s = kernels.interleave(x, y)
        plain = np.mean([0.0] + [kernels.density_entropy(s[: i + 1]) for i in range(1, n)])
        assert abs(kernels.incremental_entropy(x, y) - plain) < 1e-12
        p, q = (np.column_stack([r.random(m), r.random(m), r.integers(20, 200, m)]) for m in (n, 5))
        free = kernels.scan_match(p, q, costs=np.ones(400))  # the same prices, as a table
        assert kernels.scan_match(p, q) == free and kernels.scan_match(q, p) == kernels.scan_match(q, p, costs=np.ones(400))
    x, y = r.random(500), r.random(500)
    for v in (y, x + 0.001 * y):  # by products of matrices, and of points too near a line for that
        cov = np.cov(x, v) * 500 ** (-1 / 3)
        inv, grid = np.linalg.inv(cov), np.linspace(0, 1, 7)
        want = [[sum(np.exp(-0.5 * (d @ inv @ d)) for d in np.column_stack([a - x, b - v])) for b in grid] for a in grid]
        assert np.allclose(kernels.kde(x, v, grid, grid), np.array(want) / (500 * 2 * np.pi * np.sqrt(np.linalg.det(cov))), rtol=1e-9)


def test_transition_field_moves_no_pairs(spark):
    made = maps.transition_field(spark.createDataFrame(made_paths(12, 9)), registry.R, "x", 3)
    text = plan(made)
    assert text.index("Generate posexplode") < min(text.index(w) for w in ("Exchange", "Join"))  # of the final plan the top: nothing after it
    got = {(r["user_id"], r["i"], r["j"]): r["share"] for r in made.collect()}
    rows = made_paths(12, 9)
    for k, part in rows.groupby("user_id"):
        v = part["x"].to_numpy()
        state = np.searchsorted(np.quantile(v, [1 / 3, 2 / 3]), v)
        moves = np.zeros((3, 3))
        np.add.at(moves, (state[:-1], state[1:]), 1)
        want = moves / np.maximum(moves.sum(1, keepdims=True), 1)
        assert all(abs(got.pop((k, i, j)) - want[state[i], state[j]]) < 1e-12 for i in range(len(v)) for j in range(len(v)))
    assert not got


def test_expected_path_fwp_deals_out_steps(spark):
    rows = made_paths(30, 10).assign(cohort=lambda d: d["user_id"] % 2)
    made = paths.expected_paths(spark.createDataFrame(rows), registry.R, "fwp")
    assert "MapInPandas" in plan(made) and "hashpartitioning(cohort#" in plan(made) and ", step#" in plan(made)[plan(made).index("hashpartitioning(cohort#") :].split("\n")[0]
    got = {(r["cohort"], r["step"]): (r["x_est"], r["y_est"], r["duration_est"]) for r in made.collect()}
    for k, part in rows.groupby(["cohort", "event_id"]):
        assert np.allclose(got.pop(k), [*kernels.geometric_median(part.sort_values(["x", "y"])[["x", "y"]].to_numpy()), part["duration"].mean()])
    assert not got
