"""Small cases with known results."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.functions.aggregates import stat
from trajecta.operators import features as P
from trajecta.operators import fixations, kernels, maps, measures, paths, preprocess, tables
from trajecta.plans.extractor import Extractor, area_values, check_keys
from trajecta.roles import Roles
from trajecta.sources import datasets

R = Roles(pk=("p",), order=("t",), path_pk=("s",))


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


@pytest.fixture(scope="module")
def df(spark):
    rows = [("a", "s", float(i), x, y, 50.0 + 5 * i, 5.0 + i % 3, "AB"[i % 2]) for i, (x, y) in enumerate([(0, 0), (3, 4), (3, 8), (0, 8)])]
    rows += [("b", "s", float(i), x, y, 60.0, 6.0, "A") for i, (x, y) in enumerate([(1.0, 1.0), (2.0, 1.0)])] + [(None, "s", 0.0, 1.0, 1.0, 1.0, 1.0, "A")]
    return spark.createDataFrame([tuple(float(v) if isinstance(v, int) else v for v in r) for r in rows], "p string, s string, t double, x double, y double, duration double, dispersion double, aoi string")


def test_angles(spark):
    moves = [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, 1), (-1, -1), (1, -1), (0, 0)]
    got = values(spark, G.angle(F.col("a"), F.col("b")), [tuple(map(float, m)) for m in moves], "a double, b double")
    assert np.allclose(got, [0, 90, 180, -90, 45, 135, 225, 315, 0])
    assert values(spark, G.normalize_angle(F.col("a")), [(360.0,), (450.0,), (-45.0,), (-90.0,)], "a double") == [0, 90, 315, 270]
    assert values(spark, G.around(F.col("a"), 0, 30), [(340.0,), (20.0,), (100.0,), (None,)], "a double") == [True, True, False, False]
    four = [(1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0), (1.0, -1.0)]
    assert values(spark, G.select_moves(F.col("a"), F.col("b"), (1, 3)), four, "a double, b double") == [True, False, True, False]
    axes = [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)]
    assert values(spark, G.select_moves(F.col("a"), F.col("b"), (0,), 10), axes, "a double, b double") == [True, False, False, False]
    assert [values(spark, G.distance(F.col("a"), F.col("b"), k), [(3.0, 4.0)], "a double, b double")[0] for k in ("euc", "manhattan", "chebyshev")] == [5, 7, 4]
    assert values(spark, G.vertex_angle(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1)]), [(1,)], "a int") == [90]


def test_statistics(spark):
    v = spark.createDataFrame([(1.0, 1), (2.0, 2), (4.0, 3), (None, 4)], "v double, o int")
    row = v.agg(*[stat(s, F.col("v"), None, F.col("o")).alias(s) for s in ("min", "max", "mean", "sum", "count", "std", "median", "skew", "first", "last", "nunique", "prod", "sem")]).first()
    assert (row["min"], row["max"], row["sum"], row["count"], row["median"], row["first"], row["last"], row["nunique"], row["prod"]) == (1, 4, 7, 3, 2, 1, 4, 3, 8)
    assert abs(row["std"] - np.std([1, 2, 4], ddof=1)) < 1e-12 and abs(row["skew"] - 0.935219529582825) < 1e-9
    none = v.agg(stat("sum", F.col("v"), F.lit(False)).alias("s"), stat("count", F.col("v"), F.lit(False)).alias("c"), stat("skew", F.lit(2.0)).alias("k")).first()
    assert none["s"] is None and none["c"] is None and none["k"] == 0.0
    with pytest.raises(ValueError):
        stat("odd", F.col("v"))


def test_features(df):
    parts = [P.SaccadeFeatures({"length": ("min", "max", "sum", "count")}), P.RegressionFeatures({"mask": ("sum",)}), P.FixationFeatures({"duration": ("mean",)})]
    out = {r["p"]: r for r in Extractor(parts, R, extra={"s": "nunique"}).transform(df).collect()}
    assert set(out) == {"a", "b"} and out["a"]["sac_length_max"] == 5 and out["a"]["sac_length_sum"] == 12 and out["a"]["sac_length_count"] == 3
    assert out["a"]["reg_mask_sum"] == 1 and out["a"]["fix_duration_mean"] == 57.5 and out["b"]["id"] == "b"
    with pytest.raises(ValueError):
        check_keys(df, R)
    with pytest.raises(ValueError):
        P.SaccadeFeatures({"odd": ("min",)})
    assert area_values(df.where("p is not null"), R) == ["A", "B"]


def test_order_of_rows_does_not_matter(df):
    parts = [P.SaccadeFeatures(), P.SaccadeUnlikelihood(), P.SpectralEntropy()]
    a = Extractor(parts, R).transform(df).orderBy("p").collect()
    assert a == Extractor(parts, R).transform(df.orderBy(F.rand(1))).orderBy("p").collect()


def test_steps_in_time(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 50.0), ("a", 0.1, 1.0, 0.0, 60.0)], "p string, t double, x double, y double, duration double")
    dt = [r[0] for r in P.step_columns(rows, R).orderBy("t").select("__dt").collect()]
    assert dt[0] is None and abs(dt[1] - 0.05) < 1e-12
    assert abs(P.step_columns(rows, R.but(duration=None)).orderBy("t").select("__dt").collect()[1][0] - 0.0999) < 1e-12


def test_entropies(df):
    out = {r["p"]: r["entropy"] for r in measures.shannon_entropy(df, R).collect()}
    assert out == {"a": 1.0, "b": 0.0}


def test_native_and_kernel_agree(spark):
    r = np.random.default_rng(1)
    rows = [(k, float(i), *map(float, r.random(2))) for k in "ab" for i in range(30)]
    table = spark.createDataFrame(rows, "p string, t double, x double, y double")
    role = R.but(duration=None)
    native = {r[0]: r[1] for r in measures.correlation_dimension(table, role, r=0.3).collect()}
    rqa = {r[0]: r.asDict() for r in measures.rqa_measures(table, role, 0.3, 2).collect()}
    for k in "ab":
        p = np.array([v[2:] for v in rows if v[0] == k])
        e = kernels.delayed(kernels.interleave(p[:, 0], p[:, 1]), 2)
        close = sum(int((d < 0.3).sum()) for d in kernels.all_distances(e)) - len(e)
        assert abs(native[k] - math.log(1e-7 + close / len(e)) / math.log(0.3)) < 1e-9
        m = (np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1]) <= 0.3).astype(int)
        np.fill_diagonal(m, 0)
        n, one = len(p), np.triu(m, 1).sum() + 1e-7
        det = sum(d[i:].sum() for o in range(1, n) for d in [np.diag(m, o)] for i in range(len(d) - 1) if d[i] and d[i + 1])
        lam = sum(2 * m[i, k:].sum() for i in range(n) for k in range(n - 1) if m[i, k] and m[i, k + 1])
        want = {"rec_metric": 200 * one / (n * (n - 1)), "det": 100 * det / one, "lam": 100 * lam / (2 * one)}
        for name, v in want.items():
            assert abs(rqa[k][f"{name}_euclidean_length_2_rho_0.3"] - v) < 1e-6
    images = maps.images(table, role, ("gaf", "mtf"), (30, 30), 5).where("p = 'a'").collect()
    field = {(r["i"], r["j"]): r["v"] for r in maps.gramian_field(table, role, "x").where("p = 'a'").collect()}
    moves = {(r["i"], r["j"]): r["share"] for r in maps.transition_field(table, role, "x", 5).where("p = 'a'").collect()}
    data = {r["channel"]: np.array(r["data"]).reshape(30, 30) for r in images}
    assert all(abs(data["gaf_x"][k] - v) < 1e-9 for k, v in field.items()) and all(abs(data["mtf_x"][k] - v) < 1e-9 for k, v in moves.items())


def test_fixations(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([np.full(20, 100), np.linspace(100, 200, 10), np.full(20, 200), np.linspace(200, 300, 10), np.full(20, 300), 400 + 5 * r.standard_normal(20)])
    x = x + 0.1 * r.standard_normal(len(x))
    table = spark.createDataFrame([("a", float(t), float(v), float(v)) for t, v in zip(np.linspace(0, 1, len(x)), x, strict=True)], "p string, t double, x double, y double")
    role = R.but(duration=None, dispersion=None)
    by_speed = fixations.ivt(table, role, 500, 0.1).orderBy("start_time").collect()
    assert len(by_speed) == 3 and [round(f["x"], -2) for f in by_speed] == [100, 200, 300] and by_speed[0]["saccade_length"] == 0
    by_width = preprocess.idt_fixations(table, role, 0.1, 0.5, 20).collect()
    assert len(by_width) >= 3 and all(f["diameters"] <= 25 for f in by_width)
    assert preprocess.ihmm_fixations(table, role, fixation=(100, 50), saccade=(1200, 300), viterbi=True).count() >= 3


def test_enclosing_circle():
    assert np.allclose(kernels.enclosing_circle(np.array([(0, 0), (0, 1), (1, 0), (1, 1)])), (0.5, 0.5, math.sqrt(0.5)))
    p = np.random.default_rng(0).random((200, 2))
    cx, cy, radius = kernels.enclosing_circle(p)
    far = np.hypot(p[:, 0] - cx, p[:, 1] - cy)
    assert abs(far.max() - radius) < 1e-9 and (far > radius - 1e-9).sum() >= 2


def test_blinks(spark):
    t = np.linspace(0, 1000, 500)
    pupil = np.full(500, 4.0)
    pupil[100:200] = np.nan
    pupil[90:100], pupil[200:210] = np.linspace(4, 3.5, 10), np.linspace(3.5, 4, 10)
    (one,) = kernels.pupil_missing_blinks(pupil, t)
    assert one[2] >= 200 and one[0] < 200
    table = spark.createDataFrame([("a", float(a), None if np.isnan(b) else float(b)) for a, b in zip(t, pupil, strict=True)], "p string, t double, pupil double")
    (got,) = fixations.pupil_blinks(table, R, "pupil", sampling=500).collect()
    assert got["duration"] >= 190
    t, eo = np.linspace(0, 2000, 1000), 1 + np.random.RandomState(42).normal(0, 0.01, 1000)
    eo[200:400] -= 0.8 * np.sin(np.linspace(0, math.pi, 200))
    found = kernels.openness_blinks(eo, t, 500, min_length=50, min_amplitude=0.5)
    assert len(found) == 1 and found[0][6] < 0.21
    gap = interp = fixations.interpolate_gaps(table, R, "pupil", 10).where("pupil is null").count()
    assert gap == interp == 100 and fixations.interpolate_gaps(table, R, "pupil", 300).where("pupil is null").count() == 0


def test_areas(spark):
    r = np.random.default_rng(2)
    rows = [("a", float(20 * k + i), *map(float, c + r.standard_normal(2))) for k, c in enumerate((10.0, 100.0, 200.0)) for i in range(20)]
    table = spark.createDataFrame(rows, "p string, t double, x double, y double")
    shaped = fixations.shape_areas(table, R, (("r", (0, 0), (25, 25)), ("r", (90, 90), (115, 115))))
    assert [shaped.where(c).count() for c in ("AOI = 'aoi_0'", "AOI = 'aoi_1'", "AOI is null")] == [20, 20, 20]
    x, y = np.array(rows, dtype=object)[:, 2].astype(float), np.array(rows, dtype=object)[:, 3].astype(float)
    centres = np.stack([x, y], 1)
    groups = kernels.overlap_areas(centres, np.full(60, 5.0))
    assert len(set(groups)) <= 6 and all(len({groups[i] for i in part}) <= 2 for part in (range(20), range(20, 40), range(40, 60)))
    x, y = x / 200, y / 200 + 0.05 * np.random.default_rng(5).standard_normal(60)
    assert set(kernels.gradient_areas(x, y, 11, 0.1)) - {None} and set(kernels.threshold_areas(x, y, 11, 0.1)) - {None}
    best = preprocess.extract_areas(shaped.drop("AOI"), R.but(duration=None), {"overlap": lambda p, r: ["x"] * len(p), "other": lambda p, r: [str(i % 3) for i in range(len(p))]}, ["p"])
    assert {r["best_method"] for r in best.collect()} == {"overlap"}
    assert preprocess.match_areas(shaped.withColumn("k", F.lit(1)), R, ["k"]).count() == 60


def test_smoothing(spark):
    t = np.linspace(0, 1, 100)
    v = np.sin(10 * math.pi * t)
    assert np.allclose(kernels.savgol(t**2, 11, 2), t**2) and abs(kernels.fir_taps(21, 50, 250, True).sum() - 1) < 1e-9
    b, a = kernels.butterworth(3, 0.4, "lowpass")
    assert abs(np.polyval(b, 1) / np.polyval(a, 1) - 1) < 1e-9 and abs(np.polyval(b, np.exp(0.4j * math.pi)) / np.polyval(a, np.exp(0.4j * math.pi))) == pytest.approx(math.sqrt(0.5))
    table = spark.createDataFrame([("a", float(i), float(p), float(-p)) for i, p in zip(t, v, strict=True)], "p string, t double, x double, y double")
    counts = [preprocess.smooth(table, R, f).count() for f in (preprocess.savgol_filter(), preprocess.fir_filter(21), preprocess.fir_filter(21, mode="same"), preprocess.iir_filter(), preprocess.wiener_filter(), preprocess.wiener_filter("auto"))]
    assert counts == [100, 80, 100, 93, 100, 100] and preprocess.smooth(table, R, preprocess.savgol_filter(), preprocess.fir_filter(21)).count() == 80


def test_expected_and_fill_path(spark):
    rows = [("p1", "s", 0.0, 0.0, 0.0, 100.0), ("p1", "s", 1.0, 1.0, 1.0, 100.0), ("p2", "s", 0.0, 0.0, 0.2, 100.0), ("p2", "s", 1.0, 1.0, 1.2, 100.0)]
    table = spark.createDataFrame(rows, "p string, s string, t double, x double, y double, duration double")
    for method in ("mean", "fwp"):
        got = paths.expected_paths(table, R, method).orderBy("step").collect()
        assert np.allclose([(g["x_est"], g["y_est"]) for g in got], [(0, 0.1), (1, 1.1)], atol=1e-3)
    two = spark.createDataFrame([("u", 0, 10.0, 0.0), ("u", 1, 20.0, 1.0), ("v", 0, 0.0, 2.0), ("v", 1, 2.0, 3.0)], "s string, step int, x_est double, y_est double")
    got = paths.fill_path(two, R).orderBy("step").collect()
    assert [(g["x_est"], g["y_est"]) for g in got] == [(5, 1), (11, 2)]
    new = spark.createDataFrame([("z", "unseen", 0.0, 1.0, 1.0, 100.0)], table.schema)
    out = paths.path_distances(new, R, ("euc", "hau"), expected=paths.expected_paths(table, R)).collect()
    assert out[0]["euc_dist"] == pytest.approx(1 + 0.81)
    with pytest.raises(ValueError):
        paths.path_distances(table, R, ("odd",))


def test_distances():
    r = np.random.default_rng(4)
    p, q = (np.column_stack([r.random((n, 2)), r.integers(50, 300, n)]) for n in (7, 5))
    for name in ("euc", "hau", "man", "eye", "dfr", "dtw_textbook", "scan_match"):
        assert kernels.path_distance(name, p, p) == pytest.approx(0)
    for name in ("hau", "man", "eye", "dfr", "tde"):
        assert kernels.path_distance(name, p, q) == pytest.approx(kernels.path_distance(name, q, p))
    assert kernels.multi_match(p, p) == pytest.approx([1] * 5) and kernels.path_distance("dtw", p, q) <= kernels.path_distance("dtw_textbook", p, q)
    assert math.isnan(kernels.path_distance("euc", p[:0], q)) and all(map(math.isnan, kernels.multi_match(p[:1], q))) and math.isnan(kernels.path_distance("tde", p, q, k=6))
    n, m = len(p), len(q)
    dp = np.zeros((n + 1, m + 1))
    dp[0, 1:] = np.inf
    for i in range(1, n + 1):  # with a border column that holds the last point
        for j in range(m + 1):
            c = ((p[i - 1, :2] - q[j - 1, :2]) ** 2).sum()
            dp[i, j] = c if j == 0 else c + min(dp[i - 1, j], dp[i, j - 1], dp[i - 1, j - 1])
    assert kernels.dtw(p, q) == pytest.approx(dp[-1, -1])


def test_measures_of_known_signals():
    r = np.random.default_rng(42)
    assert 0.3 < kernels.hurst(r.standard_normal(2000)) < 0.75 and kernels.hurst(np.linspace(0, 10, 2000)) > 0.8
    x = np.sin(np.linspace(0, 10 * math.pi, 100))
    assert all(np.isfinite(v) for v in (kernels.fuzzy_entropy(x, x), kernels.sample_entropy(x, x), kernels.incremental_entropy(x, x), kernels.phase_entropy(x, x), kernels.lyapunov(x, x), kernels.fractal_dimension(5 * x, 5 * x)))
    for fill in ("mean", "last", "reduce"):
        assert np.isfinite(kernels.hurst(x, 4, fill))
    m = kernels.modes(np.column_stack([x + np.sin(np.linspace(0, 80 * math.pi, 100)), x]))
    assert np.allclose(sum(m), np.column_stack([x + np.sin(np.linspace(0, 80 * math.pi, 100)), x])) and len(kernels.hht_statistics(m[0], ("mean", "entropy", "dom_freq"))) == 3


def test_maps(spark, df):
    codes = maps.hilbert_encoding(df, R).collect()
    assert all(len(c["code"]) == 256 and sum(c["code"]) for c in codes)
    assert {r["length"] for r in maps.sequences(df, R, ["x", "y"], 3).collect()} == {2, 3} and all(len(r["rows"]) == 3 for r in maps.sequences(df, R, ["x", "y"], 3).collect())
    assert maps.recurrence_matrix(df, R, 4).where("i = j").count() == 0
    assert kernels.heatmap(np.full(4, 0.5), np.full(4, 0.5), (10, 10)).max() == 1 and abs(kernels.heatmap(np.linspace(0, 1, 5), np.full(5, 0.5), (10, 10)).sum() - 1) < 1e-9
    bars = kernels.rips_bars(np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float), 2.0)
    assert [b for b in bars if b[0] == 1] == [(1, 1.0, pytest.approx(math.sqrt(2)))] and sum(b[0] == 0 and math.isinf(b[2]) for b in bars) == 1
    assert kernels.shrink(np.arange(16.0).reshape(4, 4), 2, "max").tolist() == [[5, 7], [13, 15]] and kernels.resize(np.eye(2), (3, 3))[1, 1] == 0.5
    assert maps.marks(df, R).where("layer = 'step'").count() == 4
    nodes = maps.graph_nodes(df, R, (10, 10), (0.0, 10.0), (0.0, 10.0)).where("p = 'a'").collect()
    assert max(n["length_from"] for n in nodes) == 1 and len(nodes) == 4
    curve = maps.persistence_curve(spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.5, 2.0)], "p string, birth double, death double"), ["p"], (0.7, 3.0)).orderBy("time").collect()
    assert [c["value"] for c in curve] == [2.5, 0.0]


def test_tables(spark, df):
    rows = spark.createDataFrame([("p1", 1.0), ("p1", 2.0), ("p1", 3.0), ("p2", 5.0), ("p2", 9.0)], "p string, v double")
    z = tables.normalize(rows, ["p"], ["v"])
    assert all(abs(r[1]) < 1e-12 for r in z.groupBy("p").agg(F.avg("v_norm")).collect()) and tables.matching_columns(z, ["v"], [""]) == ["v"]
    fitted = tables.fit_normalization(rows.where("p = 'p1'"), ["p"], ["v"])
    assert {round(r["v_norm"], 6) for r in tables.apply_normalization(rows, fitted, ["p"], ["v"]).where("p = 'p1'").collect()} == {-1.0, 0.0, 1.0}
    split = tables.folds(spark.range(2000), ["id"])
    got = {r["fold"]: r["count"] for r in split.groupBy("fold").count().collect()}
    assert abs(got["train"] - 1200) < 120 and abs(got["val"] - 400) < 90 and sum(got.values()) == 2000
    assert tables.of_fold(split.drop("fold"), split, ["id"], "val").count() == got["val"]
    with pytest.raises(ValueError):
        tables.with_labels(rows, spark.createDataFrame([("p1", 1)], "p string, l int"), ["p"], strict=True)
    odd = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (float("inf"), None), (3.0, "b")], "v double, c string")
    assert sorted((r["v"], r["c"]) for r in tables.impute(odd, odd, ["v", "c"]).collect()) == [(1, "a"), (2, "a"), (2, "a"), (3, "b")]
    same = tables.classification_metrics(spark.createDataFrame([(1, 1), (0, 0)], "a int, b int"), "a", "b").first()
    assert tuple(same) == (1, 1, 1, 1) and tables.task_type(rows, "p") == "classification" and tables.task_type(df, "duration") == "classification"


def test_pairwise(df):
    matrix = tables.pairwise(df, R, lambda a, b: kernels.path_distance("hau", a, b), block=1)
    names, m = tables.collect_matrix(matrix)
    assert names == ["a", "b"] and np.allclose(m, m.T) and np.diag(m).sum() == 0
    similar = tables.collect_matrix(tables.pairwise(df, R, lambda a, b: 1 / (1 + kernels.path_distance("hau", a, b)), similarity=True))[1]
    assert np.allclose(np.diag(similar), 1) and similar.max() == 1
    _, centred = tables.collect_matrix(tables.double_centred(matrix))
    assert np.allclose(centred, kernels.double_centre(m))
    r = np.random.default_rng(0)
    points = r.random((6, 3))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    assert kernels.compromise([d, d * 2]).shape == (6, 6) and sorted(kernels.ward_order(d)) == sorted(kernels.ward_order(d, True)) == sorted(kernels.mds_order(d).tolist()) == sorted(kernels.spectral_order(np.exp(-d)).tolist()) == list(range(6))
    gram = points.T @ points
    a = kernels.restore(gram)
    assert np.allclose(a.T @ a, gram) and kernels.pca(r.random((10, 5)), p=2)[0].shape == (2, 5) and kernels.pca(r.random((10, 5)), keep=0.9)[1].shape[0] == 10
    assert [tables.order_rows(matrix, h) for h in ("hierarchical", "optimal", "mds", "spectral")]


def test_datasets(spark, tmp_path):
    spark.createDataFrame([("1,5", "2", 1.0, 3.0, "k", 1, 0.0, 2.0), ("bad", "4", 1.0, float("nan"), "k", 0, 1.0, 2.5)], "x string, y string, x_left double, x_right double, group_a string, task_label int, timestamp_start double, timestamp_end double").write.parquet(str(tmp_path / "Set_gazes.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "extracted_fixations" / "Other_fixations.parquet"))
    (tmp_path / "meta.json").write_text('{"Set_gazes": {"labels": 1}}')
    listed = datasets.list_datasets(spark, str(tmp_path)).collect()
    assert [(r["name"], r["kind"]) for r in listed] == [("Other_fixations", "fixation"), ("Set_gazes", "gaze")]
    df, meta = datasets.load_dataset(spark, str(tmp_path), "Set_gazes", normalize=True)
    assert meta == {"labels": 1} and sorted(str(r["x"]) for r in df.collect()) == ["1.5", "None"] and {r["norm_pos_y"] for r in df.collect()} == {0.5, 1.0}
    assert datasets.key_columns(df) == ["group_a"] and datasets.label_columns(df) == ["task_label"] and datasets.meta_columns(df) == []
    assert [r["duration"] for r in datasets.with_duration(df).orderBy("timestamp_start").collect()] == [2.0, 1.5] and datasets.column_roles(df)["t"] == "timestamp_start"
    assert datasets.load_dataset(spark, str(tmp_path), "Other_fixations")[1] is None
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, str(tmp_path), "none")
    datasets.write_folds(tables.folds(spark.range(50), ["id"]), str(tmp_path / "folds"), "csv")
    assert datasets.read_csv(spark, str(tmp_path / "folds")).count() == 50


def test_one_exchange_and_no_python(spark, df):
    plan = Extractor([P.SaccadeFeatures(), P.FixationFeatures(), P.SpectralEntropy()], R).transform(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Pandas" not in plan


def brute_rips(points, max_radius):
    n, d = len(points), np.linalg.norm(points[:, None] - points[None], axis=2)
    cells = [(float(max([d[a, b] for a in s for b in s])), s) for k in (1, 2, 3) for s in itertools.combinations(range(n), k)]
    cells = sorted([c for c in cells if c[0] <= max_radius], key=lambda c: (c[0], len(c[1]), c[1]))
    place, low, paired, bars = {c[1]: i for i, c in enumerate(cells)}, {}, set(), []
    for i, (r, s) in enumerate(cells):
        column = {place[s[:k] + s[k + 1 :]] for k in range(len(s))} if len(s) > 1 else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            low[max(column)] = column
            paired |= {max(column), i}
            if r > cells[max(column)][0]:
                bars.append((len(s) - 2, cells[max(column)][0], r))
    return sorted(bars + [(len(s) - 1, r, math.inf) for i, (r, s) in enumerate(cells) if i not in paired and len(s) < 3])


def test_rips_bars_of_whole_trajectories(spark):
    r = np.random.default_rng(5)
    circle = np.column_stack([np.cos(np.arange(20) * 0.3), np.sin(np.arange(20) * 0.3)])
    for points, radius in ((r.random((24, 2)), 0.8), (r.random((24, 2)), 0.3), (np.rint(r.random((26, 2)) * 4) / 4, 0.6), (circle, 1.2), (circle, 3.0), (np.zeros((3, 2)), 1.0), (np.zeros((1, 2)), 1.0)):
        assert kernels.rips_bars(points, radius) == brute_rips(points, radius)
    ring = pd.DataFrame({"p": "a", "t": np.arange(90.0), "x": np.cos(np.arange(90) * 2 * math.pi / 90), "y": np.sin(np.arange(90) * 2 * math.pi / 90)})
    bars = maps.rips_diagram(spark.createDataFrame(ring), Roles(pk=("p",), order=("t",), x="x", y="y", t="t"), 2.0).toPandas()
    assert (bars.dim == 0).sum() == 90 and (bars.dim == 1).sum() == 1 and bars[bars.dim == 1].death.iloc[0] > 1.7


def test_rips_query_takes_whole_trajectories(spark):
    from trajecta.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    points = pd.read_parquet(f"{sf}/events.parquet").groupby("user_id").size()
    got = QUERIES["rips_diagram"](spark, sf).where("dim = 0").groupBy("user_id").count().toPandas().set_index("user_id")["count"]
    assert (points > 40).any() and (got > 14).any() and (got <= points.loc[got.index]).all()
