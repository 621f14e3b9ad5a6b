"""Checks, matrices, areas, splits and drawings on small cases."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions.aggregates import stat
from trajecta.operators import kernels as K
from trajecta.operators import maps, preprocess, tables
from trajecta.operators.grouped import spread
from trajecta.plans.extractor import Extractor, check_areas, whole_rows
from trajecta.roles import Roles
from trajecta.sources import datasets

R = Roles(pk=("p",), order=("t",), path_pk=("s",))


@pytest.fixture(scope="module")
def df(spark):
    r = np.random.default_rng(4)
    rows = [(p, "s", float(i), float(x), float(y), 50.0 + i, 1.0, "AB"[i % 2]) for p in "abc" for i, (x, y) in enumerate(r.random((8, 2)))]
    return spark.createDataFrame(rows, "p string, s string, t double, x double, y double, duration double, dispersion double, aoi string")


def test_functions_and_deviations_as_statistics(spark):
    values = [1.0, 4.0, 4.0, 9.0, None]
    row = spark.createDataFrame([(v,) for v in values], "v double").agg(stat("mad", F.col("v")).alias("mad"), stat("quantile", F.col("v")).alias("q"), stat(lambda c: F.max(c) - F.min(c), F.col("v")).alias("range")).first()
    some = values[:4]
    assert row["mad"] == pytest.approx(statistics.mean(abs(v - statistics.mean(some)) for v in some)) and row["q"] == 4 and row["range"] == 8
    assert spark.createDataFrame([(None,)], "v double").agg(stat("mad", F.col("v")).alias("mad")).first()["mad"] is None


def test_rows_and_areas_are_checked(spark, df):
    holes = df.withColumn("x", F.when((F.col("p") != "b") | (F.col("t") > 1), F.col("x")))
    with pytest.warns(UserWarning, match=r"b \(2\)"):
        assert whole_rows(holes, R).count() == 22
    check_areas(df, R, ["A", "B"])
    for known, given, words in ((["A"], df, "unknown area B"), (["A", "B"], df.withColumn("aoi", F.when(F.col("t") > 0, F.col("aoi"))), "without an area")):
        with pytest.raises(ValueError, match=words):
            Extractor([], R, areas=known).transform(given)
    span = Extractor([], R, extra={"duration": lambda c: F.max(c) - F.min(c)}).transform(df).collect()
    assert {r[c] for r in span for c in r.asDict() if c.startswith("duration_")} == {7.0}


def test_auc_counts_pairs(spark):
    r = np.random.default_rng(5)
    truth, score = r.integers(0, 2, 200), np.round(r.random(200), 1)
    pos, neg = score[truth == 1], score[truth == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    rows = [(int(a), float(b)) for a, b in zip(truth, score, strict=True)] + [(None, 0.5), (1, None)]
    assert tables.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()[0] == pytest.approx(want)
    assert tables.auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()[0] is None


def test_pivot_is_bounded(df):
    out = tables.pivoted(df, ["p"], "aoi", F.sum("duration")).orderBy("p").collect()
    assert out[0]["A"] == 50 + 52 + 54 + 56 and out[0]["B"] == 51 + 53 + 55 + 57
    with pytest.raises(ValueError, match="more than 1"):
        tables.pivoted(df, ["p"], "aoi", F.sum("duration"), most=1)


def test_shrinking_is_a_valid_convolution():
    field = np.random.default_rng(6).random((9, 9))
    for how in ("mean", "normal"):
        k = 9 - 4 + 1
        w = np.array([[1.0 if how == "mean" else math.exp(-((i - 2.5) ** 2 + (j - 2.5) ** 2) / 50) for j in range(k)] for i in range(k)])
        want = [[(field[a : a + k, b : b + k] * w).sum() / w.sum() for b in range(4)] for a in range(4)]
        assert np.allclose(K.shrink(field, 4, how), want)
    assert K.shrink(field, 3, "max").tolist() == [[field[a : a + 3, b : b + 3].max() for b in (0, 3, 6)] for a in (0, 3, 6)]
    wide = np.arange(15).reshape(3, 5)
    assert K.square_of(wide).tolist() == [[1, 2, 3], [6, 7, 8], [11, 12, 13]] and K.cropped(wide, 1).tolist() == [[5, 6, 7, 8, 9]]


def test_distributions_grow_from_none_to_all():
    v = np.linspace(-50, 50, 401)
    for name in K.DISTRIBUTIONS:
        f = K.distribution(name, v, 0.5, 1.5)
        assert (np.diff(f) >= -1e-12).all() and f[0] < 0.02 and f[-1] > 0.98
    assert K.distribution("norm", np.array([1.96]), 0, 1)[0] == pytest.approx(0.975, abs=1e-4) and K.distribution("laplace", np.array([0.0]), 0, 1)[0] == 0.5


def test_ward_order_joins_the_cheapest_pair():
    rows = np.random.default_rng(7).random((14, 3))
    groups = {i: ([i], rows[i], 1) for i in range(14)}
    while len(groups) > 1:
        a, b = min(((i, j) for i in groups for j in groups if i < j), key=lambda e: groups[e[0]][2] * groups[e[1]][2] / (groups[e[0]][2] + groups[e[1]][2]) * ((groups[e[0]][1] - groups[e[1]][1]) ** 2).sum())
        (la, ca, na), (lb, cb, nb) = groups.pop(a), groups.pop(b)
        groups[a] = (la + lb, (ca * na + cb * nb) / (na + nb), na + nb)
    assert K.ward_order(rows) == next(iter(groups.values()))[0] and sorted(K.ward_order(rows, True)) == list(range(14)) and K.ward_order(rows[:0]) == []


def test_areas_are_joined_and_carried_on(spark):
    boxes = {"a": {"one": (0, 0), "two": (1, 0), "far": (9, 9)}, "b": {"left": (0.4, 0), "right": (9, 9.5)}}
    rows = [(k, float(i), x + dx, y + dy, name) for k, own in boxes.items() for name, (x, y) in own.items() for i, (dx, dy) in enumerate([(0.0, 0.0), (0.6, 0.6)])]
    df = spark.createDataFrame(rows, "k string, t double, x double, y double, AOI string")
    roles = Roles(pk=("k",), order=("t",))
    got = {(r["k"], r["AOI"]) for r in preprocess.match_areas(df, roles, ["k"], n_aoi=2).collect()}
    assert len({a for k, a in got if k == "a"}) == 2 and {a for k, a in got if k == "b"} == {a for k, a in got if k == "a"}
    apart = {(r["k"], r["AOI"]) for r in preprocess.match_areas(df, roles, ["k"], n_aoi=2, within=["k"]).collect()}
    assert {a for k, a in apart if k == "b"} == {"left", "right"}


def test_split_files_come_back(spark, tmp_path):
    split = tables.folds(spark.range(50).withColumnRenamed("id", "p"), ["p"])
    datasets.write_split_info(split, str(tmp_path / "split"), "p", "label", ["p", "s"])
    back = datasets.read_split_info(spark, str(tmp_path / "split"))
    assert {(r["p"], r["fold"]) for r in back.collect()} == {(str(r["p"]), r["fold"]) for r in split.collect()}
    for f1 in (0.5, 0.7):
        datasets.log_result(spark, str(tmp_path / "log"), model="m", f1=f1)
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_drawings_and_labels(spark, df):
    x, y = np.array([0.0, 1.0, 1.0]), np.array([0.0, 0.0, 1.0])
    assert K.drawing(x, y, (5, 5), lines=False).sum() == 3 and (K.drawing(x, y, (5, 5), points=False) > 0).sum() == 9
    assert K.drawing(x / 2, y / 2, (5, 5), zoom=True).tolist() == K.drawing(x, y, (5, 5)).tolist() and K.drawing(x[:0], y[:0], (2, 2)).sum() == 0
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "p string, label int")
    out = maps.images(df, R, list(maps.REPRESENTATIONS), (6, 6), labels=labels).collect()
    assert {r["p"] for r in out} == {"a", "b"} and {r["label"] for r in out} == {0, 1} and all(len(r["data"]) == 36 for r in out)
    assert len({r["channel"] for r in out}) == 9 + 6
    both = maps.images_and_sequences(df, R, ("heatmap", "rqa"), ["x", "y"], (4, 4), 5).collect()
    assert len(both) == 3 and all([c["channel"] for c in r["channels"]] == ["heatmap", "rqa"] and r["length"] == 8 for r in both) or all(r["length"] in (5, 8) for r in both)


def test_kernels_are_spread_over_stated_partitions(df):
    assert spread(df, ["p"], 7).rdd.getNumPartitions() == 7 and spread(df, ["p"]).rdd.getNumPartitions() >= 2 * df.sparkSession.sparkContext.defaultParallelism
