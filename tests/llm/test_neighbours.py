"""NN-descent builds the graph: what each round adds, odd sizes and values, and the answers' exactness."""

from __future__ import annotations

import numpy as np
import pytest

from trajecta.llm import neighbours
from trajecta.llm.common import arrow_map


def graph_recall(spark, x, rounds, degree=16, sample=8):
    rows = spark.createDataFrame([(i, bytes(b)) for i, b in enumerate(neighbours.encode(x / np.abs(x).max()))], "node long, vec binary")
    state = neighbours.build_graph(rows, len(x), degree, sample, rounds)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want, hit = np.argsort(d, axis=1)[:, :10], 0
    for r in state.collect():
        hit += len(set(np.frombuffer(r["w"], np.int64)[:10]) & set(want[r["node"]]))
    return hit / (10 * len(x))


def test_rounds_build_the_graph(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HOME", 128)
    x = np.random.default_rng(1).standard_normal((1200, 8))
    got = [graph_recall(spark, x, rounds) for rounds in (0, 2, 8)]
    assert got[0] < 0.1 and got[0] + 0.2 < got[1] < got[2] and got[2] > 0.9, got


def test_half_precision_copies_are_near():
    x = np.random.default_rng(2).standard_normal((50, 7)) * 10.0 ** np.arange(-32, 0, 0.64).reshape(-1, 1) / 10
    back = neighbours.decode(neighbours.encode(x))
    assert np.allclose(back / np.abs(x).max(1, keepdims=True), x / np.abs(x).max(1, keepdims=True), atol=1e-3)


@pytest.mark.parametrize("n", [2, 5, 12, 40])
def test_small_tables_are_answered_whole(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 3))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.nearest_neighbours(df, neighbours.F.expr("vec_id < 3")).collect()
    for q in range(min(n, 3)):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        got = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in got] == np.argsort(d)[: min(10, n - 1)].tolist() and all(r["score"] == pytest.approx(d[r["vec_id"]], rel=1e-12) for r in got)


def test_huge_numbers_and_near_ties(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.standard_normal((30, 4)) * 1e100, 1e99 * (1 + 1e-9 * r.standard_normal((30, 4)))])
    df = spark.createDataFrame([(i, [float(v) for v in row], "a") for i, row in enumerate(x)], "vec_id long, embedding array<double>, score string")
    out = neighbours.nearest_neighbours(df, neighbours.F.expr("vec_id % 7 = 0")).collect()
    for q in range(35, 60, 7):
        d = np.sqrt((((x - x[q]) / 1e90) ** 2).sum(1))
        d[q] = np.inf
        assert [r["vec_id"] for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == q] == np.argsort(d)[:10].tolist()


def test_arrow_batches_stay_small(spark):
    sizes = []
    arrow_map(spark.range(3).selectExpr("repeat('x', 5000000) as t"), lambda batches: (sizes.append(b.nbytes) or b for b in batches), "t string").count()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(4 << 20)
