"""Expected paths, and distances of trajectories from them: fitted once, joined by key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.operators import kernels as K
from trajecta.operators.grouped import _finite, per_trajectory, spread
from trajecta.operators.measures import numbered
from trajecta.roles import Roles


def expected_paths(df: DataFrame, roles: Roles, method: str = "mean", pad: str = "zero") -> DataFrame:
    """(path_pk, step, x_est, y_est, duration_est) of the trajectories that share path_pk.

    mean: by step; paths that are over count as zero, unless pad is "ignore". fwp: the geometric median of those present.
    """
    keys = list(roles.path_pk)
    rows = numbered(df, roles).dropna(subset=keys).withColumnRenamed("seq", "step")
    values = [roles.x, roles.y, *([roles.duration] if roles.duration else [])]
    if method == "mean":
        count = rows.groupBy(*keys).agg(F.count_distinct(*roles.pk).alias("paths"))
        sums = rows.groupBy(*keys, "step").agg(*[F.sum(v).alias(f"s{i}") for i, v in enumerate(values)], F.count("*").alias("here")).join(count, keys)
        by = F.col("paths") if pad == "zero" else F.col("here")
        return sums.select(*keys, "step", *[(F.col(f"s{i}") / by).alias(n) for i, n in enumerate(("x_est", "y_est", "duration_est")[: len(values)])])
    if method != "fwp":
        raise ValueError(f"unknown method {method}")

    def median(pdf: pd.DataFrame) -> dict:
        part = pdf[values].to_numpy(float)
        return dict(zip(("x_est", "y_est", "duration_est"), [*K.geometric_median(part[:, :2]), *part[:, 2:].mean(0)], strict=False))

    more = ", duration_est double" if roles.duration else ""
    # a step is a task's unit, not a path: all trajectories of a path would not fit in memory
    return per_trajectory(rows.select(*keys, "step", *values), roles.but(order=tuple(values)), values, median, f"x_est double, y_est double{more}", [*keys, "step"])


def fill_path(expected: DataFrame, roles: Roles, method: str = "mean") -> DataFrame:
    """The expected path of the expected paths, for keys that were not seen: (step, x_est, y_est, duration_est)."""
    names = [c for c in ("x_est", "y_est", "duration_est") if c in expected.columns]
    if method == "mean":
        total = expected.select(*roles.path_pk).distinct().agg(F.count("*").alias("paths"))
        n = total.first()["paths"]
        return expected.groupBy("step").agg(*[(F.sum(c) / F.lit(n)).alias(c) for c in names])
    own = Roles(pk=tuple(roles.path_pk), order=("__step",), x="x_est", y="y_est", duration="duration_est" if "duration_est" in names else None, path_pk=("__all",))
    return expected_paths(expected.withColumnRenamed("step", "__step").withColumn("__all", F.lit(1)), own, method).drop("__all")


def step_distances(df: DataFrame, roles: Roles, expected: DataFrame) -> DataFrame:
    """euc_dist: the sum of squared differences over the common steps (no root)."""
    rows = numbered(df, roles).select(*roles.pk, *[k for k in roles.path_pk if k not in roles.pk], F.col("seq").alias("step"), F.col(roles.x).alias("px"), F.col(roles.y).alias("py"))
    both = rows.join(expected, [*roles.path_pk, "step"])
    return both.groupBy(*roles.pk).agg(F.sum((F.col("px") - F.col("x_est")) ** 2 + (F.col("py") - F.col("y_est")) ** 2).alias("euc_dist"))


def pair_distances(df: DataFrame, roles: Roles, expected: DataFrame) -> DataFrame:
    """hau_dist, man_dist, eye_dist and tde_dist (k = 1) from all pairs of points within a trajectory and its expected path."""
    keys = list(roles.pk)
    rows = numbered(df, roles).select(*keys, *[k for k in roles.path_pk if k not in keys], "seq", F.col(roles.x).alias("px"), F.col(roles.y).alias("py"))
    pairs = rows.join(expected, list(roles.path_pk)).select(*keys, "seq", "step", ((F.col("px") - F.col("x_est")) ** 2 + (F.col("py") - F.col("y_est")) ** 2).alias("d"))
    # least and sum for each point of either path, in one pass over the pairs
    of = [F.col(k) for k in keys]
    sides = pairs.groupingSets([[*of, F.col("seq")], [*of, F.col("step")]], *of, F.col("seq"), F.col("step")).agg(F.min("d").alias("d"), F.sum("d").alias("s"))
    mine, theirs = F.col("step").isNull(), F.col("seq").isNull()
    n, m = F.count_if(mine), F.count_if(theirs)
    psum, qsum = F.sum(F.when(mine, F.col("d"))), F.sum(F.when(theirs, F.col("d")))
    return sides.groupBy(*keys).agg(
        F.sqrt(F.max("d")).alias("hau_dist"), ((m * psum + n * qsum) / (4 * n * m)).alias("man_dist"),
        ((psum + qsum) / F.greatest(n, m)).alias("eye_dist"), (F.sum(F.when(mine, F.col("s"))) / (n * m)).alias("tde_dist"),
    )


KERNELS = ("euc", "hau", "dtw", "dtw_textbook", "scan_match", "man", "eye", "dfr", "tde", "multi_match")


def path_distances(df: DataFrame, roles: Roles, methods: Sequence[str] = ("euc", "hau", "dtw", "dfr", "man", "eye"), expected: DataFrame | None = None, fill: DataFrame | None = None, expected_method: str = "mean", suffix: str = "", k: int = 1, t_bin: int = 20, partitions: int | None = None) -> DataFrame:
    """All asked distances in one grouped pass. Keys that expected does not know take the fill path.

    Fit on one set and transform another by passing expected (and fill); otherwise they are fitted on df itself.
    partitions: how many the kernels are dealt out to (see grouped.spread).
    """
    if bad := set(methods) - set(KERNELS):
        raise ValueError(f"unknown distances {sorted(bad)}")
    expected = expected_paths(df, roles, expected_method) if expected is None else expected
    fill = fill_path(expected, roles, expected_method) if fill is None else fill
    values = [c for c in ("x_est", "y_est", "duration_est") if c in expected.columns]

    def flat(order: str, columns: Sequence[str]) -> Column:
        """The rows in order as one array of doubles."""
        listed = F.array_sort(F.collect_list(F.struct(order, *columns)))
        return F.flatten(F.transform(listed, lambda r: F.array(*[r[c].cast("double") for c in columns])))

    known = expected.groupBy(*roles.path_pk).agg(flat("step", values).alias("path"))
    other = fill.agg(flat("step", values).alias("path")).first()
    spare = np.array(other["path"] if other else [], float).reshape(-1, len(values))
    keys = list(roles.pk)
    mine = [roles.x, roles.y, *([roles.duration] if roles.duration else [])]
    more = [F.first(p).alias(p) for p in roles.path_pk if p not in keys]
    own = numbered(df, roles).groupBy(*keys).agg(flat("seq", mine).alias("own"), *more)
    rows = spread(own.join(known, list(roles.path_pk), "left").select(*keys, "own", "path"), keys, partitions)
    names = [n for m in methods for n in ([f"mm_{x}{suffix}" for x in K.MULTI_MATCH] if m == "multi_match" else [f"{m}_dist{suffix}"])]

    def run(batches):
        for pdf in batches:
            out = pdf[keys].copy()
            made = []
            for a, b in zip(pdf["own"], pdf["path"], strict=True):
                p = np.asarray(a, float).reshape(-1, len(mine))
                q = np.asarray(b, float).reshape(-1, len(values)) if b is not None and len(b) else spare
                row = []
                for m in methods:
                    v = K.path_distance(m, p, q, k=k, t_bin=t_bin) if len(q) else np.nan
                    row += [_finite(x) for x in v] if m == "multi_match" and len(q) else [None] * 5 if m == "multi_match" else [_finite(v)]
                made.append(row)
            for i, n in enumerate(names):
                out[n] = pd.Series([r[i] for r in made], index=out.index, dtype=float)
            yield out

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys] + [f"`{n}` double" for n in names])
    return rows.mapInPandas(run, schema)


