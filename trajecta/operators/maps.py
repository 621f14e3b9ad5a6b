"""Matrices, tensors, sequences and graphs of trajectories, as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.geometry import angle, cell_center, grid_cell, hilbert_index, in_ranges
from trajecta.operators import kernels as K
from trajecta.operators.grouped import per_trajectory
from trajecta.operators.measures import both_triangles, numbered, recurrence
from trajecta.roles import Roles


def scaled(v: str, roles: Roles) -> Column:
    """Min-max over the trajectory; a constant one is 1, or 0 if it is 0."""
    lo, hi, c = F.min(v).over(roles.whole()), F.max(v).over(roles.whole()), F.col(v)
    return F.when(lo == hi, F.when(lo == 0, c).otherwise(1.0)).otherwise(F.try_divide(c - lo, hi - lo))


def hilbert(df: DataFrame, roles: Roles, p: int = 4) -> DataFrame:
    """(pk, seq, h): place on a Hilbert curve of order p."""
    rows = numbered(df, roles).withColumn("__u", F.rint(scaled(roles.x, roles) * 2**p)).withColumn("__v", F.rint(scaled(roles.y, roles) * 2**p))
    return rows.select(*roles.pk, "seq", hilbert_index(F.col("__u"), F.col("__v"), p).alias("h"))


def hilbert_encoding(df: DataFrame, roles: Roles, p: int = 4) -> DataFrame:
    """(pk, code): a vector of 4 ** p zeros and ones, one at each place that occurs."""
    seen = hilbert(df, roles, p).groupBy(*roles.pk).agg(F.collect_set("h").alias("s"))
    return seen.select(*roles.pk, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(4**p - 1).cast("long")), lambda k: F.array_contains("s", k).cast("int")).alias("code"))


def recurrence_matrix(df: DataFrame, roles: Roles, rho: float, name: str = "euclidean") -> DataFrame:
    """(pk, i, j) of the ones, both triangles; the diagonal is zero."""
    return both_triangles(recurrence(df, roles, rho, name), roles)


def gramian_field(df: DataFrame, roles: Roles, value: str, field: str = "difference", polar: str = "cosine") -> DataFrame:
    """(pk, i, j, v): the Gramian angular field of a column."""
    rows = numbered(df, roles)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scaled(value, roles) * 2 - 1))) if polar == "cosine" else F.atan2(F.col(roles.t), F.col(value))
    rows = rows.select(*roles.pk, "seq", phi.alias("a"))
    other = rows.select(*roles.pk, F.col("seq").alias("j"), F.col("a").alias("b"))
    v = F.cos(F.col("a") + F.col("b")) if field == "sum" else F.sin(F.col("a") - F.col("b"))
    return rows.withColumnRenamed("seq", "i").join(other, list(roles.pk)).select(*roles.pk, "i", "j", v.alias("v"))


def quantile_states(df: DataFrame, roles: Roles, value: str, n_bins: int) -> DataFrame:
    """(pk, seq, state): number of the interior quantiles below the value."""
    rows = numbered(df, roles)
    edges = df.dropna(subset=list(roles.pk)).groupBy(*roles.pk).agg(F.percentile(value, F.array(*[F.lit(k / n_bins) for k in range(1, n_bins)])).alias("edges"))
    joined = rows.select(*roles.pk, "seq", F.col(value).alias("v")).join(edges, list(roles.pk))
    return joined.select(*roles.pk, "seq", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("state"))


def transition_matrix(df: DataFrame, roles: Roles, value: str, n_bins: int = 10) -> DataFrame:
    """(pk, a, b, share): shares of the moves from state a that lead to b."""
    w = Window.partitionBy(*roles.pk).orderBy("seq")
    moves = quantile_states(df, roles, value, n_bins).withColumn("b", F.lead("state").over(w)).where("b is not null").groupBy(*roles.pk, F.col("state").alias("a"), "b").agg(F.count("*").alias("k"))
    return moves.select(*roles.pk, "a", "b", (F.col("k") / F.sum("k").over(Window.partitionBy(*roles.pk, "a"))).alias("share"))


def transition_field(df: DataFrame, roles: Roles, value: str, n_bins: int = 10) -> DataFrame:
    """(pk, i, j, share): the Markov transition field."""
    keys = list(roles.pk)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "state"))), lambda r: r["state"])
    states = quantile_states(df, roles, value, n_bins).groupBy(*keys).agg(listed.alias("states"))
    moves = transition_matrix(df, roles, value, n_bins).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct((F.col("a") * n_bins + F.col("b")).alias("k"), "share"))).alias("moves"))
    shares = F.transform(F.sequence(F.lit(0), F.lit(n_bins * n_bins - 1)), lambda k: F.coalesce(F.try_element_at("moves", k), F.lit(0.0)))
    # states and shares of a trajectory are one row; pairs are made from it last, so that none is moved
    one = states.join(moves, keys, "left").select(*keys, "states", shares.alias("shares"))
    rows = one.select(*keys, "states", "shares", F.posexplode("states").alias("i", "a")).select(*keys, "i", "a", "shares", F.posexplode("states").alias("j", "b"))
    return rows.select(*keys, "i", "j", F.get("shares", F.col("a") * n_bins + F.col("b")).alias("share"))


def _pair(name: str, make: Callable[[np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray) -> list[tuple[str, np.ndarray]]:
    return [(f"{name}_x", make(x)), (f"{name}_y", make(y))]


#: Images of a trajectory by name: functions of (x, y, t, areas, shape, n_bins) that give channels.
REPRESENTATIONS: dict[str, Callable[..., list[tuple[str, np.ndarray]]]] = {
    "heatmap": lambda x, y, t, a, shape, n: [("heatmap", K.heatmap(x, y, shape))],
    "heatmap_zoomed": lambda x, y, t, a, shape, n: [("heatmap_zoomed", K.heatmap(K.minmax(x), K.minmax(y), shape))],
    "gaf": lambda x, y, t, a, shape, n: _pair("gaf", lambda v: K.resize(K.gramian(v, t), shape), x, y),
    "gaf_sum": lambda x, y, t, a, shape, n: _pair("gaf_sum", lambda v: K.resize(K.gramian(v, t, "sum"), shape), x, y),
    "mtf": lambda x, y, t, a, shape, n: _pair("mtf", lambda v: K.resize(K.transition_field(v, n), shape), x, y),
    "rqa": lambda x, y, t, a, shape, n: [("rqa", K.resize((np.hypot(x[:, None] - x, y[:, None] - y) <= 0.1).astype(float), shape))],
} | {
    f"{name}{'_zoomed' * zoom}": lambda x, y, t, a, shape, n, name=name, zoom=zoom: [(f"{name}{'_zoomed' * zoom}", K.drawing(x, y, shape, name != "aoi", name != "saccade", a if name == "aoi" else None, zoom))]
    for name in ("baseline", "aoi", "saccade")
    for zoom in (False, True)
}


def images(df: DataFrame, roles: Roles, kinds: Sequence[str] = ("heatmap",), shape: tuple[int, int] = (32, 32), n_bins: int = 10, labels: DataFrame | None = None) -> DataFrame:
    """(pk, channel, h, w, data): images of each trajectory, channels by the kinds of REPRESENTATIONS. labels: a table with the key and labels, which are put beside (a key without labels is left out).

    Drawings: baseline has points and steps, saccade steps, aoi points by their area; _zoomed ones fill the image.
    """
    if bad := set(kinds) - set(REPRESENTATIONS):
        raise ValueError(f"unknown images {sorted(bad)}")
    areas = any(k.startswith("aoi") for k in kinds)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, t = (pdf[c].to_numpy(float) for c in (roles.x, roles.y, roles.t))
        shade = None
        if areas:
            code, names = pd.factorize(pdf[roles.aoi], sort=True)
            shade = (code + 1) / (len(names) + 1)  # no area is 0
        if len(x) < 2:
            x, y, t = (np.repeat(v, 2) for v in (x, y, t))
            shade = None if shade is None else np.repeat(shade, 2)
        out = [c for k in kinds for c in REPRESENTATIONS[k](x, y, t, shade, shape, n_bins)]
        return pd.DataFrame({"channel": [k for k, _ in out], "h": np.int32(shape[0]), "w": np.int32(shape[1]), "data": [m.ravel().tolist() for _, m in out]})

    made = per_trajectory(df, roles, [roles.x, roles.y, roles.t, *([roles.aoi] if areas else [])], f, "channel string, h int, w int, data array<double>")
    return made if labels is None else made.join(labels, list(roles.pk))


def images_and_sequences(df: DataFrame, roles: Roles, kinds: Sequence[str], columns: Sequence[str], shape: tuple[int, int] = (32, 32), max_length: int = 10) -> DataFrame:
    """(pk, channels, rows, length): both forms of each trajectory in one row; channels is an array of (channel, h, w, data), by name."""
    own = images(df, roles, kinds, shape).groupBy(*roles.pk).agg(F.array_sort(F.collect_list(F.struct("channel", "h", "w", "data"))).alias("channels"))
    return own.join(sequences(df, roles, columns, max_length), list(roles.pk))


def sequences(df: DataFrame, roles: Roles, columns: Sequence[str], max_length: int = 10) -> DataFrame:
    """(pk, rows, length): the first max_length rows of columns, filled up with zeros."""
    row = F.array(*[F.col(c).cast("double") for c in columns])
    listed = numbered(df, roles).where(F.col("seq") < max_length).groupBy(*roles.pk).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("r")))), lambda s: s["r"]).alias("r"))
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), len(columns)), max_length)
    return listed.select(*roles.pk, F.slice(F.concat("r", zero), 1, max_length).alias("rows"), F.size("r").alias("length"))


def _cells(df: DataFrame, roles: Roles, shape: tuple[int, int], xlim: tuple[float, float], ylim: tuple[float, float]) -> DataFrame:
    w = Window.partitionBy(*roles.pk).orderBy("seq")
    rows = numbered(df, roles).withColumn("ci", grid_cell(F.col(roles.x), *xlim, shape[0])).withColumn("cj", grid_cell(F.col(roles.y), *ylim, shape[1])).withColumn("cell", F.col("ci") * shape[1] + F.col("cj"))
    step = F.sqrt((F.lead(roles.x).over(w) - F.col(roles.x)) ** 2 + (F.lead(roles.y).over(w) - F.col(roles.y)) ** 2)
    return rows.withColumn("to", F.lead("cell").over(w)).withColumn("step", step)


def graph_edges(df: DataFrame, roles: Roles, shape: tuple[int, int] = (10, 10), xlim: tuple[float, float] = (0.0, 1.0), ylim: tuple[float, float] = (0.0, 1.0), directed: bool = True) -> DataFrame:
    """(pk, src, dst, times, weight) of moves between cells; weights are total lengths as shares of the largest."""
    rows = _cells(df, roles, shape, xlim, ylim).where("to is not null and to <> cell").select(*roles.pk, F.col("cell").alias("src"), F.col("to").alias("dst"), "step")
    if not directed:
        rows = rows.unionByName(rows.select(*roles.pk, F.col("dst").alias("src"), F.col("src").alias("dst"), "step"))
    edges = rows.groupBy(*roles.pk, "src", "dst").agg(F.count("*").alias("times"), F.sum("step").alias("s"))
    return edges.select(*roles.pk, "src", "dst", "times", F.try_divide("s", F.max("s").over(roles.whole())).alias("weight"))


def graph_nodes(df: DataFrame, roles: Roles, shape: tuple[int, int] = (10, 10), xlim: tuple[float, float] = (0.0, 1.0), ylim: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(pk, cell, duration, length_to, length_from, center_x, center_y): shares of the largest. Durations count where the next row stays; centres are known for cells that were left."""
    rows = _cells(df, roles, shape, xlim, ylim)
    stay, move = F.col("to") == F.col("cell"), F.col("to") != F.col("cell")
    own = rows.groupBy(*roles.pk, "cell").agg(F.coalesce(F.sum(F.when(stay, F.col(roles.duration))), F.lit(0.0)).alias("d"), F.coalesce(F.sum(F.when(move, F.col("step"))), F.lit(0.0)).alias("o"), F.max(F.when(move, F.col("ci"))).alias("i"), F.max(F.when(move, F.col("cj"))).alias("j"))
    into = rows.where(move).groupBy(*roles.pk, F.col("to").alias("cell")).agg(F.sum("step").alias("t"))
    out = own.join(into, [*roles.pk, "cell"], "left").fillna(0.0, ["t"])

    def share(c: str) -> Column:
        top = F.max(c).over(roles.whole())
        return F.when(top > 0, F.col(c) / top).otherwise(F.col(c))

    return out.select(*roles.pk, "cell", share("d").alias("duration"), share("t").alias("length_to"), share("o").alias("length_from"), F.coalesce(cell_center(F.col("i"), *xlim, shape[0]), F.lit(0.0)).alias("center_x"), F.coalesce(cell_center(F.col("j"), *ylim, shape[1]), F.lit(0.0)).alias("center_y"))


def kde_heatmap(df: DataFrame, roles: Roles, n: int = 10) -> DataFrame:
    """(pk, i, j, v): Gaussian density (Scott's rule) at n x n points of the unit square, for trajectories that don't lie on a line."""
    keys, w = list(roles.pk), roles.whole()
    x, y = F.col(roles.x), F.col(roles.y)
    rows = df.dropna(subset=keys).select(*keys, x.alias("px"), y.alias("py"), F.count("*").over(w).cast("double").alias("n"), F.var_samp(x).over(w).alias("a"), F.covar_samp(x, y).over(w).alias("b"), F.var_samp(y).over(w).alias("c"))
    s = F.pow(F.col("n"), F.lit(-1 / 3))
    rows = rows.withColumns({v: F.col(v) * s for v in "abc"}).withColumn("det", F.col("a") * F.col("c") - F.col("b") ** 2).where("n > 2 and det > 1e-14 * (a + c) * (a + c)")
    # rows become n * n only in the task that sums them, never in a side of a join, whose size Spark would take for that of the rows
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    grid = rows.withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    u, v = F.col("i") / (n - 1) - F.col("px"), F.col("j") / (n - 1) - F.col("py")
    form = (F.col("c") * u * u - 2 * F.col("b") * u * v + F.col("a") * v * v) / F.col("det")
    return grid.groupBy(*keys, "i", "j").agg((F.sum(F.exp(-form / 2)) / F.first("n") / (2 * F.pi() * F.sqrt(F.first("det")))).alias("v"))


def persistence_curve(bars: DataFrame, keys: Sequence[str], times: Sequence[float], entropy: bool = False) -> DataFrame:
    """(keys, time, value): at each time the total length of the bars (birth, death) alive, or the entropy of their shares. Bars without end are null."""
    at = bars.select(*keys, "birth", "death", F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("time"))
    length = F.when((F.col("birth") <= F.col("time")) & (F.col("time") < F.col("death")), F.col("death") - F.col("birth"))
    total = F.sum(length)
    value = F.ln(total) - F.sum(F.when(length > 0, length * F.ln(length))) / total if entropy else total
    return at.groupBy(*keys, "time").agg(F.coalesce(F.when(F.lit(not entropy) | (total > 0), value), F.lit(0.0)).alias("value"))


def lower_star(df: DataFrame, roles: Roles, value: str) -> DataFrame:
    """(pk, dim, birth, death): every sample is a component that never dies (death null): the filtration has no edges."""
    return df.dropna(subset=list(roles.pk)).select(*roles.pk, F.lit(0).alias("dim"), F.col(value).cast("double").alias("birth"), F.lit(None).cast("double").alias("death"))


def rips_diagram(df: DataFrame, roles: Roles, max_radius: float = 1.0, max_points: int | None = None) -> DataFrame:
    """(pk, dim, birth, death) of the Vietoris-Rips filtration of whole trajectories up to loops; ones of more than max_points, if given, are an error. Memory grows with the square of their length."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        if max_points is not None and len(pdf) > max_points:
            raise ValueError(f"{len(pdf)} points: more than {max_points}")
        out = pd.DataFrame(K.rips_bars(pdf[[roles.x, roles.y]].to_numpy(float), max_radius), columns=["dim", "birth", "death"]).astype({"dim": "int32"})
        out["death"] = out["death"].replace(np.inf, np.nan)
        return out

    return per_trajectory(df, roles, [roles.x, roles.y], f, "dim int, birth double, death double")


def marks(df: DataFrame, roles: Roles, shape_column: str | None = None, return_range: tuple[float, float] = (135, 225)) -> DataFrame:
    """A declarative drawing: (pk, layer, seq, x0, y0, x1, y1, bin, backward): points with a size bin of five, and steps."""
    w = Window.partitionBy(*roles.pk).orderBy("seq")
    size = F.col(shape_column or roles.duration)
    rows = numbered(df, roles).withColumn("__top", F.max(size).over(roles.whole()))
    points = rows.select(*roles.pk, F.lit("point").alias("layer"), "seq", F.col(roles.x).alias("x0"), F.col(roles.y).alias("y0"), F.col(roles.x).alias("x1"), F.col(roles.y).alias("y1"), F.when(size < F.col("__top"), F.floor(size / F.col("__top") * 5).cast("int")).alias("bin"), F.lit(False).alias("backward"))
    steps = rows.withColumn("__nx", F.lead(roles.x).over(w)).withColumn("__ny", F.lead(roles.y).over(w)).where("__nx is not null")
    turn = in_ranges(angle(F.col("__nx") - F.col(roles.x), F.col("__ny") - F.col(roles.y)), [return_range])
    return points.unionByName(steps.select(*roles.pk, F.lit("step").alias("layer"), "seq", F.col(roles.x).alias("x0"), F.col(roles.y).alias("y0"), F.col("__nx").alias("x1"), F.col("__ny").alias("y1"), F.lit(None).cast("int").alias("bin"), turn.alias("backward")))
