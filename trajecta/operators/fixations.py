"""Fixations by velocity, their features, blinks, gaps and areas, as window expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.geometry import angle, distance, vertex_angle
from trajecta.roles import Roles


def islands(df: DataFrame, flag: Column, roles: Roles, name: str = "island") -> DataFrame:
    """Numbers the maximal runs of rows with flag from 1; null elsewhere."""
    w = roles.window()
    df = df.withColumn("__f", F.coalesce(flag, F.lit(False)))
    start = F.col("__f") & ~F.coalesce(F.lag("__f").over(w), F.lit(False))
    count = F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.when(F.col("__f"), count)).drop("__f")


def ivt_runs(df: DataFrame, roles: Roles, threshold: float, kind: str = "euc", eps: float = 1e-10) -> DataFrame:
    """Rows with fixation_id: runs in which the velocity to the next row is at most threshold. The last row drops out."""
    w = roles.window()
    rows = df.dropna(subset=list(roles.pk))
    rows = rows.withColumn("__step", distance(F.lead(roles.x).over(w) - F.col(roles.x), F.lead(roles.y).over(w) - F.col(roles.y), kind)).withColumn("__dt", F.lead(roles.t).over(w) - F.col(roles.t))
    return islands(rows.where(F.col("__dt").isNotNull()), F.try_divide(F.col("__step"), F.col("__dt") + eps) <= threshold, roles, "fixation_id")


def roll_up(runs: DataFrame, roles: Roles) -> DataFrame:
    """One row for each fixation: mean place, first and last time, shortest and longest step."""
    more = [F.max(roles.dispersion).alias("dispersion")] if roles.dispersion and roles.dispersion in runs.columns else []
    return runs.where("fixation_id is not null").groupBy(*roles.pk, "fixation_id").agg(
        F.avg(roles.x).alias("x"), F.avg(roles.y).alias("y"), F.min(roles.t).alias("start_time"), F.max(roles.t).alias("end_time"), F.min("__step").alias("distance_min"), F.max("__step").alias("distance_max"), *more
    )


def fixation_features(fixations: DataFrame, roles: Roles) -> DataFrame:
    """Adds duration, the step from the fixation before (0 for the first) and the angle at inner ones (0 at the ends)."""
    w = Window.partitionBy(*roles.pk).orderBy("start_time", "fixation_id")
    px, py, nx, ny = F.lag("x").over(w), F.lag("y").over(w), F.lead("x").over(w), F.lead("y").over(w)
    dx, dy = F.col("x") - px, F.col("y") - py
    zero = F.lit(0.0)
    return fixations.withColumns({
        "duration": F.col("end_time") - F.col("start_time"), "saccade_duration": F.coalesce(F.col("start_time") - F.lag("end_time").over(w), zero), "saccade_length": F.coalesce(distance(dx, dy), zero),
        "saccade_angle": F.coalesce(angle(dx, dy), zero), "saccade2_angle": F.coalesce(F.when(px.isNotNull() & nx.isNotNull(), vertex_angle(px, py, F.col("x"), F.col("y"), nx, ny)), zero),
    })


def ivt(df: DataFrame, roles: Roles, threshold: float, min_duration: float, kind: str = "euc") -> DataFrame:
    """Fixations with their features; those shorter than min_duration go after the features are made."""
    return fixation_features(roll_up(ivt_runs(df, roles, threshold, kind), roles), roles).where(F.col("duration") >= min_duration)


def merge_intervals(blinks: DataFrame, keys: Sequence[str], min_separation: float, min_duration: float) -> DataFrame:
    """Joins intervals (onset, offset) with less than min_separation between them, then drops spans shorter than min_duration."""
    w = Window.partitionBy(*keys).orderBy("onset", "offset")
    new = F.coalesce(F.col("onset") - F.lag("offset").over(w) >= min_separation, F.lit(True))
    joined = blinks.withColumn("__new", new.cast("int")).withColumn("__span", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = joined.groupBy(*keys, "__span").agg(F.min("onset").alias("onset"), F.max("offset").alias("offset")).drop("__span")
    return out.withColumn("duration", F.col("offset") - F.col("onset")).where(F.col("duration") >= min_duration)


def missing_runs(df: DataFrame, roles: Roles, value: str) -> DataFrame:
    """(pk, onset, offset, first, last, n): runs of rows without a value."""
    rows = df.dropna(subset=list(roles.pk)).withColumn("seq", F.row_number().over(roles.window()) - 1)
    runs = islands(rows, F.col(value).isNull() | F.isnan(F.col(value).cast("double")), roles, "run").where("run is not null")
    return runs.groupBy(*roles.pk, "run").agg(F.min(roles.t).alias("onset"), F.max(roles.t).alias("offset"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n")).drop("run")


def pupil_blinks(df: DataFrame, roles: Roles, value: str, gap: float = 20, min_duration: float = 20, min_separation: float = 50, sampling: float | None = None) -> DataFrame:
    """Blinks: runs without a value that last longer than gap, joined; runs over gaps in the recording (steps above 2 / sampling seconds, times in milliseconds) are left out."""
    runs = missing_runs(df, roles, value).where(F.col("offset") - F.col("onset") > gap)
    if sampling:
        w = roles.window()
        steps = df.dropna(subset=list(roles.pk)).select(*roles.pk, F.lag(roles.t).over(w).alias("lo"), F.col(roles.t).alias("hi")).where(F.col("hi") - F.col("lo") > 2000 / sampling)
        touch = [runs[k] == steps[k] for k in roles.pk] + [runs["onset"] <= steps["hi"], runs["offset"] >= steps["lo"]]
        runs = runs.join(steps, touch, "left_anti")
    return merge_intervals(runs.select(*roles.pk, "onset", "offset"), roles.pk, min_separation, min_duration)


def interpolate_gaps(df: DataFrame, roles: Roles, value: str, gap: float) -> DataFrame:
    """Fills runs without a value that last at most gap, linearly by row number; at the ends with the nearest value."""
    w = roles.window()
    back, ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    v = F.col(value)
    rows = df.dropna(subset=list(roles.pk)).withColumn("seq", F.row_number().over(w) - 1)
    rows = islands(rows, v.isNull(), roles, "run")
    span = Window.partitionBy(*roles.pk, "run")
    rows = rows.withColumn("__len", F.when(F.col("run").isNotNull(), F.max(roles.t).over(span) - F.min(roles.t).over(span)))
    known = F.when(v.isNotNull(), F.struct(F.col("seq").alias("s"), v.alias("v")))
    rows = rows.withColumn("__a", F.last(known, ignorenulls=True).over(back)).withColumn("__b", F.first(known, ignorenulls=True).over(ahead))
    blend = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("seq") - F.col("__a.s")) / F.nullif(F.col("__b.s") - F.col("__a.s"), F.lit(0))
    filled = F.when(v.isNotNull(), v).when(F.col("__len") <= gap, F.coalesce(blend, F.col("__a.v"), F.col("__b.v")))
    return rows.withColumn(value, filled).drop("__len", "__a", "__b", "run")


def shape_areas(df: DataFrame, roles: Roles, shapes: Sequence[tuple], name: str = "AOI") -> DataFrame:
    """Labels rows aoi_0, aoi_1, ... by the last shape that holds them, else null.

    Shapes: ("r", (x0, y0), (x1, y1)) with its sides; ("c", (cx, cy), r); ("e", (cx, cy), (a, b), degrees), of which the
    second term is linear in the distance across, not squared.
    """
    x, y = F.col(roles.x), F.col(roles.y)
    out = F.lit(None).cast("string")
    for i, (kind, *p) in enumerate(shapes):
        if kind == "r":
            (x0, y0), (x1, y1) = p
            test = x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1))
        elif kind == "c":
            (cx, cy), r = p
            test = F.sqrt((x - cx) ** 2 + (y - cy) ** 2) <= r
        elif kind == "e":
            (cx, cy), (a, b), turn = p
            c, s = F.cos(F.radians(F.lit(float(turn)))), F.sin(F.radians(F.lit(float(turn))))
            test = ((x - cx) * c + (y - cy) * s) ** 2 / a**2 + ((x - cx) * s - (y - cy) * c) / b**2 <= 1
        else:
            raise ValueError(f"unknown shape {kind}")
        out = F.when(test, f"aoi_{i}").otherwise(out)
    return df.withColumn(name, out)
