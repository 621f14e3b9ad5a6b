"""Row operators that need a kernel: smoothing, fixations, blinks, areas. One grouped pass each; several can be chained in one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.operators import kernels as K
from trajecta.operators.fixations import fixation_features
from trajecta.operators.grouped import key_schema, per_trajectory
from trajecta.roles import Roles

Smoother = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, slice]]


def savgol_filter(window: int = 11, degree: int = 2) -> Smoother:
    return lambda x, y: (K.savgol(x, window, degree), K.savgol(y, window, degree), slice(None))


def fir_filter(taps: int = 81, fs: float = 250, cutoff: float | Sequence[float] = 100, pass_zero: bool = False, mode: str = "valid") -> Smoother:
    h = K.fir_taps(taps, cutoff, fs, pass_zero)

    def run(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, slice]:
        if len(x) <= taps:
            return x, y, slice(None)
        (a, rows), (b, _) = K.fir(x, h, mode), K.fir(y, h, mode)
        return a, b, rows

    return run


def iir_filter(order: int = 7, edge: float = 0.5, kind: str = "highpass") -> Smoother:
    b, a = K.butterworth(order, edge, kind)

    def run(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, slice]:
        if len(x) <= order:
            return x[:0], y[:0], slice(0, 0)
        (u, rows), (v, _) = K.iir(x, b, a), K.iir(y, b, a)
        return u, v, rows

    return run


def wiener_filter(noise: float | str = 4.3e-5, sigma: float = 0.2, size: int = 11) -> Smoother:
    """noise "auto" is chosen for each trajectory on its own."""

    def run(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, slice]:
        k = K.wiener_auto(x, y, sigma, size) if noise == "auto" and len(x) > size else noise
        return (x, y, slice(None)) if len(x) <= size else (K.wiener(x, k, sigma, size), K.wiener(y, k, sigma, size), slice(None))

    return run


def smooth(df: DataFrame, roles: Roles, *filters: Smoother) -> DataFrame:
    """df's rows with x and y smoothed by the filters in turn; rows that a filter can't serve drop out."""
    columns = [c for c in df.columns if c not in roles.pk]

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        for each in filters:
            x, y, rows = each(pdf[roles.x].to_numpy(float), pdf[roles.y].to_numpy(float))
            pdf = pdf.iloc[rows].copy()
            pdf[roles.x], pdf[roles.y] = x, y
        return pdf[columns]

    schema = ", ".join(f"`{c}` {'double' if c in (roles.x, roles.y) else df.schema[c].dataType.simpleString()}" for c in columns)
    return per_trajectory(df, roles, columns, f, schema)


def _roll_up(pdf: pd.DataFrame, roles: Roles, number: np.ndarray, step: np.ndarray) -> pd.DataFrame:
    out = []
    x, y, t = (pdf[c].to_numpy(float) for c in (roles.x, roles.y, roles.t))
    for k in range(1, int(number.max(initial=0)) + 1):
        at = np.flatnonzero(number == k)
        if len(at):
            cx, cy, r = K.enclosing_circle(np.stack([x[at], y[at]], 1))
            w, h = np.ptp(x[at]), np.ptp(y[at])
            out.append((k, x[at].mean(), y[at].mean(), t[at].min(), t[at].max(), step[at].min(), step[at].max(), float(np.hypot(w, h)), 2 * r, cx, cy))
    return pd.DataFrame(out, columns=["fixation_id", "x", "y", "start_time", "end_time", "distance_min", "distance_max", "dispersion", "diameters", "center_x", "center_y"])


ROLLED = "fixation_id int, x double, y double, start_time double, end_time double, distance_min double, distance_max double, dispersion double, diameters double, center_x double, center_y double"


def idt_fixations(df: DataFrame, roles: Roles, min_duration: float, max_duration: float, max_dispersion: float, kind: str = "euc") -> DataFrame:
    """Fixations by dispersion, with enclosing circle and features; trajectories without any give no rows."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, t = (pdf[c].to_numpy(float) for c in (roles.x, roles.y, roles.t))
        step = np.append(K.step_lengths(x, y, kind), 0.0)
        return _roll_up(pdf, roles, K.idt(x, y, t, min_duration, max_duration, max_dispersion, kind), step).astype({"fixation_id": "int32"})

    return fixation_features(per_trajectory(df, roles, [roles.x, roles.y, roles.t], f, ROLLED), roles)


def ihmm_fixations(df: DataFrame, roles: Roles, fix2sac: float = 0.05, sac2fix: float = 0.05, fixation: tuple[float, float] = (0.002, 0.001), saccade: tuple[float, float] = (0.03, 0.005), viterbi: bool = False, kind: str = "euc", eps: float = 1e-10, distributions: tuple[str, str] = ("norm", "norm")) -> DataFrame:
    """Fixations by a two-state hidden Markov model of velocities; distributions: names of kernels.DISTRIBUTIONS for fixations and saccades."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, t = (pdf[c].to_numpy(float) for c in (roles.x, roles.y, roles.t))
        if len(x) < 2:
            return _roll_up(pdf, roles, np.zeros(len(x), int), np.zeros(len(x))).astype({"fixation_id": "int32"})
        step = K.step_lengths(x, y, kind)
        flag = K.ihmm(step / (np.diff(t) + eps), fix2sac, sac2fix, fixation, saccade, viterbi, kinds=distributions)
        number = np.zeros(len(x), int)
        for k, (a, b) in enumerate(K.runs(flag), 1):
            number[a : b + 1] = k
        return _roll_up(pdf, roles, number, np.append(step, 0.0)).astype({"fixation_id": "int32"})

    return fixation_features(per_trajectory(df, roles, [roles.x, roles.y, roles.t], f, ROLLED), roles)


def enclosing_circles(rows: DataFrame, roles: Roles, by: Sequence[str] = ("fixation_id",)) -> DataFrame:
    """(pk, by, diameters, center_x, center_y) of the points of each group, such as the runs of fixations.ivt_runs."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        points, groups = pdf[[roles.x, roles.y]].to_numpy(float), pdf.groupby(list(by), sort=False).indices
        made = [K.enclosing_circle(points[at]) for at in groups.values()]
        names = pdf[list(by)].iloc[[at[0] for at in groups.values()]].reset_index(drop=True)
        return names.assign(diameters=[2 * r for _, _, r in made], center_x=[x for x, _, _ in made], center_y=[y for _, y, _ in made])

    # dealt out by trajectories, not by groups, of which most have few points
    made = per_trajectory(rows.dropna(subset=list(by)), roles, [*by, roles.x, roles.y], f, f"{key_schema(rows, by)}, diameters double, center_x double, center_y double")
    return made.select(*roles.pk, *by, "diameters", "center_x", "center_y")


def missing_pupil_blinks(df: DataFrame, roles: Roles, value: str, **parameters) -> DataFrame:
    """(pk, onset, offset, duration) by missing pupil sizes; times in milliseconds."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(K.pupil_missing_blinks(pdf[value].to_numpy(float), pdf[roles.t].to_numpy(float), **parameters), columns=["onset", "offset", "duration"]).astype(float)

    return per_trajectory(df, roles, [value, roles.t], f, "onset double, offset double, duration double")


def without_outliers(df: DataFrame, roles: Roles, value: str, window: int, least: float = 2) -> DataFrame:
    """df's rows with outlying pupil sizes null."""
    columns = [c for c in df.columns if c not in roles.pk]

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[columns].copy()
        pdf[value] = K.drop_outliers(pdf[value].to_numpy(float), window, least)
        return pdf

    return per_trajectory(df, roles, columns, f, key_schema(df.withColumn(value, F.col(value).cast("double")), columns))


def openness_blinks(df: DataFrame, roles: Roles, value: str, fs: float, **parameters) -> DataFrame:
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(K.openness_blinks(pdf[value].to_numpy(float), pdf[roles.t].to_numpy(float), fs, **parameters), columns=list(K.OPENNESS)).astype(float)

    return per_trajectory(df, roles, [value, roles.t], f, ", ".join(f"{c} double" for c in K.OPENNESS))


AreaMethod = Callable[[pd.DataFrame, Roles], list]


def threshold_method(window: int, threshold: float, kind: str = "kmeans", reach: float | None = None) -> AreaMethod:
    return lambda pdf, r: [None if k is None else f"aoi_{k}" for k in K.threshold_areas(pdf[r.x].to_numpy(float), pdf[r.y].to_numpy(float), window, threshold, kind, reach)]


def gradient_method(window: int, threshold: float) -> AreaMethod:
    return lambda pdf, r: [None if k is None else f"aoi_{k}" for k in K.gradient_areas(pdf[r.x].to_numpy(float), pdf[r.y].to_numpy(float), window, threshold)]


def overlap_method(diameters: str = "diameters", centers: Sequence[str] = ("center_x", "center_y"), eps: float = 0.0) -> AreaMethod:
    def run(pdf: pd.DataFrame, r: Roles) -> list:
        return [str(k) for k in K.overlap_areas(pdf[list(centers)].to_numpy(float), pdf[diameters].to_numpy(float), eps)]

    return run


def cluster_method(estimator) -> AreaMethod:
    """Any object with fit_predict; negative labels are no area."""
    return lambda pdf, r: [None if k < 0 else f"aoi_{int(k)}" for k in estimator.fit_predict(pdf[[r.x, r.y]].to_numpy(float))]


def area_entropy(labels: Sequence) -> float:
    p = pd.Series(labels).value_counts(normalize=False) / max(1, len(labels))
    return float(-(p * np.log2(p)).sum())


def extract_areas(df: DataFrame, roles: Roles, methods: dict[str, AreaMethod], instance: Sequence[str], name: str = "AOI", centre: bool = True, columns: Sequence[str] = ()) -> DataFrame:
    """For each instance the areas of the method with the least entropy (the first of equals), renamed aoi_0, aoi_1, ...; best_method says which.

    With several methods, each trajectory is first centred on its mean. Methods that fail on an instance are left out; if
    all fail there are no areas.
    """
    keep = [c for c in dict.fromkeys([*roles.pk, *roles.order, roles.x, roles.y, *columns]) if c not in instance]

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        work, best, least, label = pdf.copy(), None, np.inf, [None] * len(pdf)
        if centre and len(methods) > 1:
            own = [k for k in roles.pk if k in work]
            work[[roles.x, roles.y]] = work[[roles.x, roles.y]] - (work.groupby(own)[[roles.x, roles.y]].transform("mean") if own else work[[roles.x, roles.y]].mean())
        for m, method in methods.items():
            try:
                got = method(work, roles)
            except (ValueError, IndexError, np.linalg.LinAlgError):
                continue
            names = {k: f"aoi_{i}" for i, k in enumerate(dict.fromkeys(g for g in got if g is not None))}
            got = [names.get(g) for g in got]
            if (e := area_entropy(got)) < least:
                best, least, label = m, e, got
        out = pdf[keep].copy()
        out[name], out["best_method"] = label, best
        return out

    rows = df.withColumn("__instance", F.lit(1)) if not instance else df
    schema = f"{key_schema(df, keep)}, `{name}` string, best_method string"
    got = per_trajectory(rows, roles, keep, f, schema, list(instance) or ["__instance"])
    return got.drop("__instance")


def _merged(names: list, centres: np.ndarray, weights: np.ndarray, most: int) -> dict:
    """Which area each one becomes when the two with the nearest centres are joined, again and again, until most are left; the earlier name stays."""
    names, centres, weights, becomes = list(names), centres.astype(float).copy(), weights.astype(float).copy(), {k: k for k in names}
    while len(names) > most:
        d = np.linalg.norm(centres[:, None] - centres[None], axis=2)
        d[np.tril_indices(len(d))] = np.inf
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        centres[i] = (centres[i] * weights[i] + centres[j] * weights[j]) / (weights[i] + weights[j])
        weights[i] += weights[j]
        becomes = {k: names[i] if v == names[j] else v for k, v in becomes.items()}
        del names[j]
        centres, weights = np.delete(centres, j, 0), np.delete(weights, j)
    return becomes


def match_areas(df: DataFrame, roles: Roles, instance: Sequence[str], aoi: str = "AOI", n_aoi: int | None = None, within: Sequence[str] = (), centre: bool = False) -> DataFrame:
    """Carries labels from instance to instance, in their order: of as many areas, each takes the label of the box of the earlier pattern that it overlaps most.

    n_aoi: areas with near centres are first joined until so many are left. centre: boxes are compared about the mean of
    their instance. within: columns of instance whose values each begin a new run of instances; instances of one run are
    matched in one task, from one small row for each instance and area.
    """
    rows = df.where(F.col(aoi).isNotNull())
    if centre:
        mean = rows.groupBy(*instance).agg(F.avg(roles.x).alias("__mx"), F.avg(roles.y).alias("__my"))
        rows = rows.join(mean, list(instance))
    x, y = (F.col(c) - F.col(m) if centre else F.col(c) for c, m in ((roles.x, "__mx"), (roles.y, "__my")))
    boxes = rows.groupBy(*instance, aoi).agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1"), F.avg(x).alias("__cx"), F.avg(y).alias("__cy"), F.count("*").cast("double").alias("__k"))
    box = ["__x0", "__x1", "__y0", "__y1"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, patterns = [], {}
        for _, part in pdf.sort_values([*instance, aoi], kind="stable").groupby(list(instance), sort=True, dropna=False):
            names = part[aoi].tolist()
            becomes = _merged(names, part[["__cx", "__cy"]].to_numpy(), part["__k"].to_numpy(), n_aoi or len(names))
            own = {}
            for name, b in zip(names, part[box].to_numpy(), strict=True):
                o = own.get(becomes[name])
                own[becomes[name]] = b if o is None else np.array([min(o[0], b[0]), max(o[1], b[1]), min(o[2], b[2]), max(o[3], b[3])])
            before, given = patterns.get(len(own)), {k: k for k in own}
            if before:
                p, q = list(own), list(before)
                u, v = np.stack([own[k] for k in p])[:, None], np.stack([before[k] for k in q])[None]
                common = np.maximum(0, np.minimum(u[..., 1], v[..., 1]) - np.maximum(u[..., 0], v[..., 0])) * np.maximum(0, np.minimum(u[..., 3], v[..., 3]) - np.maximum(u[..., 2], v[..., 2]))
                given, taken = {}, set()
                for _, a, b in sorted((-common[i, j], a, b) for i, a in enumerate(p) for j, b in enumerate(q)):
                    if a not in given and b not in taken:
                        given[a] = b
                        taken.add(b)
            patterns[len(own)] = {given[k]: v for k, v in own.items()}
            part = part[[*instance, aoi]].copy()
            part["__label"] = [given[becomes[k]] for k in names]
            out.append(part)
        return pd.concat(out)

    keys = list(within)
    table = boxes.withColumn("__run", F.lit(0)).groupBy(*keys, "__run").applyInPandas(run, f"{key_schema(df, [*instance, aoi])}, __label string")
    return df.join(table, [*instance, aoi], "left").withColumn(aoi, F.col("__label")).drop("__label").select(*df.columns)
