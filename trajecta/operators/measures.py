"""Measures that are plain aggregates or joins within a trajectory: entropies, recurrence, correlation dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.roles import Roles

EPS = 1e-7


def numbered(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows with a whole key, and seq (from 0) and n, the length of the trajectory."""
    return df.dropna(subset=list(roles.pk)).withColumn("seq", F.row_number().over(roles.window()) - 1).withColumn("n", F.count("*").over(roles.whole()))


def shannon_entropy(df: DataFrame, roles: Roles) -> DataFrame:
    """Bits of the shares of the areas. Rows without an area count in the total, but are no area."""
    cells = df.dropna(subset=list(roles.pk)).groupBy(*roles.pk, roles.aoi).agg(F.count("*").alias("__k"))
    cells = cells.withColumn("__share", F.col("__k") / F.sum("__k").over(roles.whole()))
    return cells.groupBy(*roles.pk).agg(F.coalesce(F.sum(F.when(F.col(roles.aoi).isNotNull(), -F.col("__share") * F.log2("__share"))), F.lit(0.0)).alias("entropy"))


def grid_bin(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Number of the bin of n equal ones from lo to hi, the upper end included; a constant axis spans one around it."""
    lo, hi = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    return F.least(F.floor((v - lo) / (hi - lo) * n), F.lit(n - 1)).cast("int")


def gridded_entropy(df: DataFrame, roles: Roles, grid_size: int = 10) -> DataFrame:
    w = roles.whole()
    x, y = F.col(roles.x), F.col(roles.y)
    cells = df.dropna(subset=list(roles.pk)).select(*roles.pk, grid_bin(x, F.min(x).over(w), F.max(x).over(w), grid_size).alias("i"), grid_bin(y, F.min(y).over(w), F.max(y).over(w), grid_size).alias("j"))
    cells = cells.groupBy(*roles.pk, "i", "j").agg(F.count("*").alias("__k")).withColumn("__share", F.col("__k") / F.sum("__k").over(w))
    return cells.groupBy(*roles.pk).agg(F.sum(-F.col("__share") * F.ln("__share")).alias(f"gridded_entropy_grid_size_{grid_size}"))


def metric(ax: Column, ay: Column, bx: Column, by: Column, name: str = "euclidean") -> Column:
    dx, dy = ax - bx, ay - by
    if name == "euclidean":
        return F.sqrt(dx * dx + dy * dy)
    if name == "sqeuclidean":
        return dx * dx + dy * dy
    if name == "manhattan":
        return F.abs(dx) + F.abs(dy)
    if name == "chebyshev":
        return F.greatest(F.abs(dx), F.abs(dy))
    raise ValueError(f"unknown metric {name}")


def recurrence(df: DataFrame, roles: Roles, rho: float = 0.1, name: str = "euclidean") -> DataFrame:
    """(pk, i, j, n) for i < j of points within rho: the upper triangle of the recurrence matrix."""
    rows = numbered(df, roles).select(*roles.pk, "seq", "n", F.col(roles.x).alias("px"), F.col(roles.y).alias("py"))
    other = rows.select(*roles.pk, F.col("seq").alias("j"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    pairs = rows.withColumnRenamed("seq", "i").join(other, list(roles.pk)).where(F.col("i") < F.col("j"))
    return pairs.where(metric(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"), name) <= rho).select(*roles.pk, "i", "j", "n")


def both_triangles(cells: DataFrame, roles: Roles) -> DataFrame:
    """(pk, i, j) of both triangles."""
    ends = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return cells.select(*roles.pk, F.explode(ends).alias("__cell")).select(*roles.pk, "__cell.i", "__cell.j")


def _with_rest(cells: DataFrame, roles: Roles, line: Sequence[str], at: str, min_length: int) -> DataFrame:
    """cells with rest: for each that starts min_length filled ones in its line, the number of filled cells from it on; else null."""
    w = Window.partitionBy(*roles.pk, *line).orderBy(at)
    rest = F.count("*").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    run = F.lead(at, min_length - 1).over(w) == F.col(at) + min_length - 1 if min_length > 1 else F.lit(True)
    return cells.withColumn("rest", F.when(F.coalesce(run, F.lit(False)), rest))


def rqa_measures(df: DataFrame, roles: Roles, rho: float = 0.1, min_length: int = 1, name: str = "euclidean", measures: Sequence[str] = ("rec", "det", "lam", "corm")) -> DataFrame:
    """Recurrence, determinism, laminarity and centre of recurrence in percent. Lines are weighed by what is left of them, so determinism can exceed 100.

    The pairs of points are formed once, and once more for laminarity.
    """
    cells = recurrence(df, roles, rho, name)
    keys = list(roles.pk)
    sizes = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").cast("double").alias("n"))
    lines = _with_rest(cells.withColumn("o", F.col("j") - F.col("i")), roles, ["o"], "i", min_length) if "det" in measures else cells.withColumn("rest", F.lit(0))
    sums = lines.groupBy(*keys).agg(F.count("*").alias("m"), F.sum(F.col("j") - F.col("i")).alias("far"), F.sum("rest").alias("dl"))
    out = sizes.join(sums, keys, "left").fillna(0, ["m", "far"])
    if "lam" in measures:
        lam = _with_rest(both_triangles(cells, roles), roles, ["i"], "j", min_length)  # the matrix is symmetric: rows and columns alike
        out = out.join(lam.groupBy(*keys).agg(F.sum("rest").alias("hl")), keys, "left")
    r = F.col("m") + EPS
    made = {
        "rec": F.when(F.col("n") > 1, 200 * r / (F.col("n") * (F.col("n") - 1))), "corm": F.when(F.col("n") > 1, 100 * F.col("far") / ((F.col("n") - 1) * r)),
        "det": 100 * F.coalesce("dl", F.lit(0)) / r, "lam": 100 * 2 * F.coalesce("hl", F.lit(0)) / (2 * r) if "lam" in measures else None,
    }
    names = {m: f"{m}{'_metric' if m == 'rec' else ''}_{name}_length_{min_length}_rho_{rho}" for m in measures}
    return out.select(*keys, *[made[m].alias(names[m]) for m in measures])


def interleaved(df: DataFrame, roles: Roles) -> DataFrame:
    """(pk, k, v): x and y of the rows in turn."""
    rows = numbered(df, roles)
    return rows.select(*roles.pk, F.explode(F.array(F.struct((F.col("seq") * 2).alias("k"), F.col(roles.x).alias("v")), F.struct((F.col("seq") * 2 + 1).alias("k"), F.col(roles.y).alias("v")))).alias("__pair")).select(*roles.pk, "__pair.k", "__pair.v")


def embedded(df: DataFrame, roles: Roles, m: int = 2, tau: int = 1) -> DataFrame:
    """(pk, k, v0 .. v{m-1}): delay vectors of the interleaved sequence."""
    w = Window.partitionBy(*roles.pk).orderBy("k")
    out = interleaved(df, roles).select(*roles.pk, "k", *[F.lead("v", d * tau).over(w).alias(f"v{d}") for d in range(m)])
    return out.where(F.col(f"v{m - 1}").isNotNull())


def correlation_dimension(df: DataFrame, roles: Roles, m: int = 2, tau: int = 1, r: float = 0.5) -> DataFrame:
    rows = embedded(df, roles, m, tau)
    keys = list(roles.pk)
    other = rows.select(*keys, F.col("k").alias("k2"), *[F.col(f"v{d}").alias(f"u{d}") for d in range(m)])
    square = sum(((F.col(f"v{d}") - F.col(f"u{d}")) ** 2 for d in range(1, m)), (F.col("v0") - F.col("u0")) ** 2)
    close = rows.join(other, keys).where((F.col("k") != F.col("k2")) & (F.sqrt(square) < r)).groupBy(*keys).agg(F.count("*").alias("c"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    value = F.ln(F.lit(EPS) + F.coalesce("c", F.lit(0)) / F.col("n")) / F.ln(F.lit(r))
    return sizes.join(close, keys, "left").select(*keys, value.alias(f"corr_dim_m_{m}_tau_{tau}_r_{r}"))
