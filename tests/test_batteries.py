"""Batteries and reports: grids agree with single measures, plans stay one."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators import kernels as K
from trajecta.operators import measures, reports, tables
from trajecta.operators.grouped import run_kernels
from trajecta.plans import batteries as B
from trajecta.roles import Roles

R = Roles(pk=("p",), order=("t",), path_pk=("s",), aoi=None)


@pytest.fixture(scope="module")
def df(spark):
    r = np.random.default_rng(4)
    rows = [(k, "s", float(i), *map(float, r.random(2)), 50.0 + i, 2.0) for k, n in (("a", 30), ("b", 12), ("c", 1)) for i in range(n)]
    return spark.createDataFrame(rows, "p string, s string, t double, x double, y double, duration double, dispersion double")


def points(df, key):
    got = df.where(F.col("p") == key).orderBy("t").select("x", "y").collect()
    return np.array([r[0] for r in got]), np.array([r[1] for r in got])


def test_grids_agree_with_single_measures(df):
    grid = [B.fuzzy_entropy((1, 2), (0.1, 0.2)), B.sample_entropy((1, 2), (0.1, 0.3)), B.correlation_dimension((2, 3), (1, 2), (0.2, 0.4)), B.hurst("y", (2, 3), ("last", "reduce")), B.gridded_entropy((4, 10)), B.hht(2)]
    out = {r["p"]: r.asDict() for r in run_kernels(df, R, grid).collect()}
    x, y = points(df, "a")
    for m in (1, 2):
        assert math.isclose(out["a"][f"fuzzy_m_{m}_r_0.2"], K.fuzzy_entropy(x, y, m, 0.2)) and math.isclose(out["a"][f"sample_entropy_m={m}_r=0.3"], K.sample_entropy(x, y, m, 0.3))
    assert math.isclose(out["a"]["hurst_y_n3_fill_reduce"], K.hurst(y, 3, "reduce"))
    native = {r["p"]: r[1] for r in measures.correlation_dimension(df, R, 3, 2, 0.4).collect()}
    assert math.isclose(out["b"]["corr_dim_m_3_tau_2_r_0.4"], native["b"])
    cells = {r["p"]: r[1] for r in measures.gridded_entropy(df, R, 4).collect()}
    assert all(math.isclose(out[k]["gridded_entropy_grid_size_4"], v, abs_tol=1e-12) for k, v in cells.items())
    assert out["c"]["corr_dim_m_3_tau_2_r_0.4"] is None and out["c"]["gridded_entropy_grid_size_4"] == 0


@pytest.mark.parametrize("name", ["euclidean", "chebyshev"])
def test_recurrence_kernel_agrees_with_joins(df, name):
    out = {r["p"]: r.asDict() for r in run_kernels(df, R, [B.recurrence((0.2, 0.4), (1, 2), metric=name)]).collect()}
    for length in (1, 2):
        for r in measures.rqa_measures(df.where("p <> 'c'"), R, 0.4, length, name).collect():
            for c, v in r.asDict().items():
                assert c == "p" or math.isclose(out[r["p"]][c], v, abs_tol=1e-9)


def test_batteries(df):
    simple, extended, full = (f(R).transform(df.where("p <> 'c'")) for f in (B.simple_battery, B.extended_battery, B.complex_battery))
    assert simple.count() == 2 and "sac_speed_skew" in extended.columns and "sac_speed_skew" not in B.extended_battery(R.but(duration=None)).transform(df).columns
    assert len(full.columns) == 1 + 30 + 18 + 18 + 1 + 7 + 25 + 25 + 15 + 105 + 96 + 30 + 2 + 1 and full.count() == 2
    both = B.merge_batteries({"one": simple, "two": full.select("p", "entropy" if "entropy" in full.columns else "spectral_entropy")}, ["p"])
    assert both.columns[0] == "p" and "one_sac_length_sum" in both.columns and "two_spectral_entropy" in both.columns
    plan = extended._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_distances_are_fitted_on_train(df):
    out = {r["p"]: r.asDict() for r in B.distance_battery(df, df.where("p = 'a'"), R, ("euc", "hau")).collect()}
    assert abs(out["a"]["euc_dist_mean"]) < 1e-12 and out["b"]["euc_dist_mean"] > 0 and set(out["a"]) == {"p", "euc_dist_mean", "hau_dist_mean", "euc_dist_fwp", "hau_dist_fwp"}


def test_reports(spark, df, tmp_path):
    row = reports.length_report(df, R).first()
    assert (row["trajectories"], row["rows_min"], row["rows_max"]) == (3, 1, 30) and abs(row["rows_std"] - np.std([30, 12, 1])) < 1e-9
    assert reports.varied_labels(df, ["p", "s"]) == ["p"]
    fitted = reports.override_normalization(tables.fit_normalization(df, ["p"], ["x"]), "p", "x", {"a": 150}, {"a": 50})
    got = tables.apply_normalization(df, fitted, ["p"], ["x"]).where("p = 'a'").select("x", "x_norm").collect()
    assert all(math.isclose(r[1], (r[0] - 150) / 50) for r in got)
    curve = reports.topological_features(df.where("p <> 'c'"), R, 0.5, 1.0, 5)
    assert curve.count() == 10 and curve.where("curve < 0 or entropy is null").count() == 0
    path = str(tmp_path / "kept")
    assert reports.saved(spark, path, lambda: df).count() == 43 and reports.saved(spark, path, lambda: df.limit(0)).count() == 43
