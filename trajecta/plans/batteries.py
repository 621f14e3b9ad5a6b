"""Named measures with their output columns, and the batteries of features made of them.

A battery is one plan: its statistics share a window pass and an aggregation, its measures one grouped kernel. Measures
over a grid of parameters make each distance matrix once and read all of the grid from it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from trajecta.operators import features as P
from trajecta.operators import kernels as K
from trajecta.operators import paths
from trajecta.operators.grouped import Kernel
from trajecta.plans.extractor import Extractor
from trajecta.roles import Roles

UNDEFINED = (ValueError, IndexError, ZeroDivisionError, FloatingPointError, np.linalg.LinAlgError)
BASIC = ("mean", "std", "min", "max", "count", "sum")
EXTENDED = ("mean", "std", "min", "max", "count", "median", "skew", "kurtosis")
EPS = 1e-7


def _or_nan(f: Callable[[], Sequence[float]], n: int) -> list[float]:
    """One point of a grid may be undefined (too short a trajectory) without the others."""
    try:
        return list(f())
    except UNDEFINED:
        return [math.nan] * n


def _grid(names: Sequence[str], parts: Sequence[tuple[Callable, int]]) -> Kernel:
    """A kernel that runs parts, each a function of (x, y) with so many results."""
    return Kernel(names, lambda x, y, t, p: [v for f, n in parts for v in _or_nan(lambda f=f: f(x, y), n)])


def hurst(coordinate: str = "x", n_iters: Sequence[int] = (10,), fills: Sequence[str] = ("last",)) -> Kernel:
    points = [(n, f) for n in n_iters for f in fills]
    names = [f"hurst_{coordinate}_n{n}_fill_{f}" for n, f in points]
    return Kernel(names, lambda x, y, t, p: [v for n, f in points for v in _or_nan(lambda n=n, f=f: [K.hurst(p[coordinate].to_numpy(float), n, f)], 1)], [coordinate])


def fuzzy_entropy(ms: Sequence[int] = (2,), rs: Sequence[float] = (0.2,)) -> Kernel:
    def run(x: np.ndarray, y: np.ndarray, m: int) -> list[float]:
        s, phi = K.interleave(x, y), []
        for size in (m, m + 1):
            e = K.delayed(s, size)[: len(s) - size]
            total = np.zeros(len(rs))
            for d in K.all_distances(e, "chebyshev"):
                total += [np.exp(-(d**2) / (2 * r * r)).sum() for r in rs]
            phi.append(total / len(e))
        return np.log(phi[0] / (phi[1] + EPS)).tolist()

    return _grid([f"fuzzy_m_{m}_r_{r}" for m in ms for r in rs], [(lambda x, y, m=m: run(x, y, m), len(rs)) for m in ms])


def sample_entropy(ms: Sequence[int] = (2,), rs: Sequence[float] = (0.2,)) -> Kernel:
    def matches(s: np.ndarray, m: int) -> np.ndarray:
        e = K.delayed(s, m)
        return sum(np.array([int((d < r).sum()) for r in rs]) for d in K.all_distances(e, "chebyshev")) - len(e)

    def run(x: np.ndarray, y: np.ndarray, m: int) -> list[float]:
        s = K.interleave(x, y)
        return (-np.log(matches(s, m + 1) / (matches(s, m) + 1e-6) + 1e-100)).tolist()

    return _grid([f"sample_entropy_m={m}_r={r}" for m in ms for r in rs], [(lambda x, y, m=m: run(x, y, m), len(rs)) for m in ms])


def incremental_entropy() -> Kernel:
    return Kernel(["incremental_entropy"], lambda x, y, t, p: [K.incremental_entropy(x, y)])


def gridded_entropy(sizes: Sequence[int] = (10,)) -> Kernel:
    def bins(v: np.ndarray, g: int) -> np.ndarray:
        lo, hi = (v.min(), v.max()) if v.min() < v.max() else (v.min() - 0.5, v.max() + 0.5)
        return np.minimum(np.floor((v - lo) / (hi - lo) * g), g - 1)

    def run(x: np.ndarray, y: np.ndarray, g: int) -> list[float]:
        share = np.unique(bins(x, g) * g + bins(y, g), return_counts=True)[1] / len(x)
        return [float(-(share * np.log(share)).sum())]

    return _grid([f"gridded_entropy_grid_size_{g}" for g in sizes], [(lambda x, y, g=g: run(x, y, g), 1) for g in sizes])


def phase_entropy(ms: Sequence[int] = (2,), taus: Sequence[int] = (1,)) -> Kernel:
    points = [(m, tau) for m in ms for tau in taus]
    return _grid([f"phase_entropy_m_{m}_tau_{tau}" for m, tau in points], [(lambda x, y, m=m, tau=tau: [K.phase_entropy(x, y, m, tau)], 1) for m, tau in points])


def lyapunov_exponent(ms: Sequence[int] = (2,), taus: Sequence[int] = (1,), horizon: int = 1) -> Kernel:
    points = [(m, tau) for m in ms for tau in taus]
    return _grid([f"lyapunov_exponent_m_{m}_tau_{tau}_T_{horizon}" for m, tau in points], [(lambda x, y, m=m, tau=tau: [K.lyapunov(x, y, m, tau, horizon)], 1) for m, tau in points])


def fractal_dimension(ms: Sequence[int] = (2,), taus: Sequence[int] = (1,)) -> Kernel:
    points = [(m, tau) for m in ms for tau in taus]
    return _grid([f"fractal_dim_m_{m}_tau_{tau}" for m, tau in points], [(lambda x, y, m=m, tau=tau: [K.fractal_dimension(x, y, m, tau)], 1) for m, tau in points])


def correlation_dimension(ms: Sequence[int] = (2,), taus: Sequence[int] = (1,), rs: Sequence[float] = (0.5,)) -> Kernel:
    def run(x: np.ndarray, y: np.ndarray, m: int, tau: int) -> list[float]:
        e = K.delayed(K.interleave(x, y), m, tau)
        close = sum(np.array([int((d < r).sum()) for r in rs]) for d in K.all_distances(e)) - len(e)
        return (np.log(EPS + close / len(e)) / np.log(rs)).tolist()

    points = [(m, tau) for m in ms for tau in taus]
    return _grid([f"corr_dim_m_{m}_tau_{tau}_r_{r}" for m, tau in points for r in rs], [(lambda x, y, m=m, tau=tau: run(x, y, m, tau), len(rs)) for m, tau in points])


def _lines(cells: np.ndarray, length: int) -> float:
    """For each cell that starts length filled ones in its row, the number of filled cells from it on; added up."""
    before = np.concatenate([np.zeros((len(cells), 1), int), cells.cumsum(1)], axis=1)
    starts = before[:, length:] - before[:, :-length] == length
    return float(((before[:, -1:] - before[:, : starts.shape[1]]) * starts).sum())


def recurrence(rhos: Sequence[float] = (0.1,), lengths: Sequence[int] = (1,), measures: Sequence[str] = ("rec", "det", "lam", "corm"), metric: str = "euclidean") -> Kernel:
    """Recurrence quantification in one kernel, for many parameters at once; operators.measures has it as joins."""

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
        return {"euclidean": lambda: np.sqrt(dx * dx + dy * dy), "sqeuclidean": lambda: dx * dx + dy * dy, "manhattan": lambda: dx + dy, "chebyshev": lambda: np.maximum(dx, dy)}[metric]()

    def run(x: np.ndarray, y: np.ndarray) -> list[float]:
        n, d = len(x), apart(x, y)
        if n < 2:
            raise ValueError("too short")
        at = np.arange(n)
        far = at[None] - at[:, None]
        shifted = at[:, None] + at[None]  # row o, column i: the cell (i, i + o)
        out = []
        for rho in rhos:
            cells = (d <= rho).astype(int)
            np.fill_diagonal(cells, 0)
            r = float(np.triu(cells).sum()) + EPS
            diagonals = np.where(shifted < n, cells[at[None], np.minimum(shifted, n - 1)], 0)[1:]
            for length in lengths:
                made = {"rec": 200 * r / (n * (n - 1)), "corm": 100 * float((far * np.triu(cells)).sum()) / ((n - 1) * r), "det": 100 * _lines(diagonals, length) / r, "lam": 100 * _lines(cells, length) / r}
                out += [made[m] for m in measures]
        return out

    names = [f"{m}{'_metric' if m == 'rec' else ''}_{metric}_length_{length}_rho_{rho}" for rho in rhos for length in lengths for m in measures]
    return _grid(names, [(run, len(names))])


def hht(most: int = 3, features: Sequence[str] = ("mean", "std")) -> Kernel:
    """Statistics of the first modes; of trajectories with fewer the others are null."""

    def run(x: np.ndarray, y: np.ndarray) -> list[float]:
        found = K.modes(np.column_stack([x, y]), most)[:most]
        return [v for m in found for v in K.hht_statistics(m, features)] + [math.nan] * (len(features) * (most - len(found)))

    return _grid([f"imf{i}_{f}" for i in range(most) for f in features], [(run, most * len(features))])


def simple_battery(roles: Roles) -> Extractor:
    return Extractor([P.FixationFeatures({"duration": BASIC}), P.SaccadeFeatures({"length": BASIC})], roles)


def extended_battery(roles: Roles) -> Extractor:
    """Without a duration there are no speeds, accelerations and fixation durations."""
    steps = {"length": (*EXTENDED, "sum"), "direction_angle": EXTENDED, "rotation_angle": EXTENDED}
    back: dict[str, Sequence[str]] = {"length": EXTENDED, "mask": ("sum",)}
    if not roles.duration:
        return Extractor([P.SaccadeFeatures(steps), P.RegressionFeatures(back)], roles)
    return Extractor([P.FixationFeatures({"duration": (*EXTENDED, "sum")}), P.SaccadeFeatures(steps | {"speed": EXTENDED, "acceleration": EXTENDED}), P.RegressionFeatures(back | {"speed": EXTENDED})], roles)


def complex_battery(roles: Roles) -> Extractor:
    """All measures over their grids of parameters."""
    five, radii = (1, 2, 3, 4, 5), (0.05, 0.1, 0.15, 0.2, 0.3, 0.4)
    kernels = [
        *[hurst(c, five, ("last", "mean", "reduce")) for c in (roles.x, roles.y)], fuzzy_entropy((1, 2, 3), radii), sample_entropy((1, 2, 3), radii), incremental_entropy(), gridded_entropy((4, 5, 6, 7, 8, 16, 32)),
        phase_entropy(five, five), lyapunov_exponent(five, five), fractal_dimension((2, 3, 4), five), correlation_dimension((2, 3, 4), five, (*radii, 0.5)), recurrence(radii, (1, 2, 3, 4)), hht(6, ("mean", "std", "var", "entropy", "energy")),
    ]
    return Extractor([P.SpectralEntropy(), P.SaccadeUnlikelihood()], roles, kernels)


def distance_battery(df: DataFrame, train: DataFrame, roles: Roles, methods: Sequence[str] = ("euc", "hau", "dtw", "man", "eye", "dfr", "tde", "multi_match"), expected: Sequence[str] = ("mean", "fwp")) -> DataFrame:
    """Distances of df's trajectories from expected paths that are fitted on train only; names end in the way of fitting."""
    out = None
    for how in expected:
        fitted = paths.expected_paths(train, roles, how)
        each = paths.path_distances(df, roles, methods, fitted, paths.fill_path(fitted, roles, how), how, f"_{how}")
        out = each if out is None else out.join(each, list(roles.pk), "full")
    return out


def merge_batteries(batteries: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row for each key, columns named by battery and feature; keys that a battery lacks have nulls."""
    out = None
    for name, df in batteries.items():
        each = df.select(*keys, *[df[f"`{c}`"].alias(f"{name}_{c}") for c in df.columns if c not in keys and c != "id"])
        out = each if out is None else out.join(each, list(keys), "full")
    return out
