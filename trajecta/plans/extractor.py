"""One plan for many features: a shared window pass, one aggregation, at most one grouped kernel."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.operators.features import step_columns
from trajecta.roles import Roles


def check_keys(df: DataFrame, roles: Roles) -> None:
    """Raise if a key is null."""
    bad = F.lit(False)
    for k in roles.pk:
        bad = bad | F.col(k).isNull()
    if df.where(bad).limit(1).count():
        raise ValueError(f"null in {roles.pk}")


def whole_rows(df: DataFrame, roles: Roles, most: int = 20) -> DataFrame:
    """df without rows that hold a null in any column; warns of the trajectories (at most so many by name) that lose some."""
    bad = F.lit(False)
    for c in df.columns:
        bad = bad | F.col(f"`{c}`").isNull()
    lost = with_id(df.where(bad), roles).groupBy("id").agg(F.count("*").alias("n")).orderBy("id").limit(most + 1).collect()
    if lost:
        warnings.warn("rows with nulls are left out of " + ", ".join(f"{r['id']} ({r['n']})" for r in lost[:most]) + ", ..." * (len(lost) > most), stacklevel=2)
    return df.where(~bad)


def check_areas(df: DataFrame, roles: Roles, known: Sequence[str]) -> None:
    """Raise if a row has no area, or one that is not known."""
    odd = df.where(F.col(roles.aoi).isNull() | ~F.col(roles.aoi).isin(*known)).select(roles.aoi).limit(1).collect()
    if odd:
        raise ValueError("rows without an area" if odd[0][0] is None else f"unknown area {odd[0][0]}")


def with_id(df: DataFrame, roles: Roles) -> DataFrame:
    """Adds id: the key's values joined by ``_``. The key's own columns keep their types."""
    return df.withColumn("id", F.concat_ws("_", *[F.col(k).cast("string") for k in roles.pk]))


def area_values(df: DataFrame, roles: Roles, most: int = 1000) -> list[str]:
    """The areas of interest, by first appearance; more than most of them are an error."""
    found = df.where(F.col(roles.aoi).isNotNull()).groupBy(roles.aoi).agg(F.min(F.struct(*roles.order, *roles.pk)).alias("at")).orderBy("at", roles.aoi).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} areas")
    return [r[0] for r in found]


class Extractor:
    """Parts with ``aggregates(roles)`` become one aggregation over one window pass; kernels join on the key.

    extra: column -> statistic (a name, or a function that makes an aggregate), carried along for each trajectory. Rows
    with a null key are left out unless strict. areas: those that may occur; others, and rows without, are an error.
    """

    def __init__(self, parts: Sequence, roles: Roles, kernels: Sequence = (), extra: dict[str, str | Callable] | None = None, strict: bool = False, areas: Sequence[str] | None = None) -> None:
        self.parts, self.roles, self.kernels, self.extra, self.strict, self.areas = list(parts), roles, list(kernels), extra or {}, strict, areas

    def transform(self, df: DataFrame) -> DataFrame:
        from trajecta.functions.aggregates import stat
        from trajecta.operators.grouped import run_kernels

        roles = self.roles
        if self.strict:
            check_keys(df, roles)
        if self.areas is not None:
            check_areas(df, roles, self.areas)
        rows = df.dropna(subset=list(roles.pk))
        wide = step_columns(rows, roles)
        if any(getattr(p, "areas", ()) for p in self.parts):
            wide = wide.withColumn("__same_aoi", F.lag(roles.aoi).over(roles.window()) == F.col(roles.aoi))
            wide = step_columns(wide, roles, "_in", roles.aoi)
        columns = [a for p in self.parts for a in p.aggregates(roles)]
        columns += [stat(s, F.col(c), None, F.struct(*roles.order)).alias(f"{c}_{s if isinstance(s, str) else getattr(s, '__name__', 'value')}") for c, s in self.extra.items()]
        out = wide.groupBy(*roles.pk).agg(*columns) if columns else rows.select(*roles.pk).distinct()
        if self.kernels:
            out = out.join(run_kernels(rows, roles, self.kernels), list(roles.pk), "left")
        return with_id(out, roles)
