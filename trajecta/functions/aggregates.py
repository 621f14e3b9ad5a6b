"""Statistics by name, with pandas' conventions: samples' moments corrected for bias, null for too few values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STATS = ("min", "max", "mean", "sum", "count", "std", "var", "median", "skew", "kurtosis", "sem", "nunique", "first", "last", "prod", "quantile", "mad")


def stat(name: str | Callable[[Column], Column], value: Column, selected: Column | None = None, order: Column | None = None) -> Column:
    """The aggregate of value over selected rows. sum and count are null if no row is selected, 0 if all values are null.

    name may be a function that makes an aggregate of a column. quantile is the median; mad the mean deviation from the mean.
    """
    chosen = F.lit(True) if selected is None else F.coalesce(selected, F.lit(False))
    v = F.when(chosen, value.cast("double") if name != "nunique" else value)
    if callable(name):
        return name(v)
    n, any_row = F.count(v).cast("double"), F.count_if(chosen) > 0
    flat = F.var_pop(v) == 0
    if name in ("min", "max"):
        return getattr(F, name)(v)
    if name == "mean":
        return F.avg(v)
    if name == "sum":
        return F.when(any_row, F.coalesce(F.sum(v), F.lit(0.0)))
    if name == "count":
        return F.when(any_row, F.count(v))
    if name == "std":
        return F.stddev_samp(v)
    if name == "var":
        return F.var_samp(v)
    if name == "mad":
        values = F.collect_list(v)
        total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
        mean = total / F.size(values)
        return F.when(F.size(values) > 0, F.aggregate(F.transform(values, lambda u: F.abs(u - mean)), F.lit(0.0), lambda a, b: a + b) / F.size(values))
    if name in ("median", "quantile"):
        return F.median(v)
    if name == "sem":
        return F.stddev_samp(v) / F.sqrt(n)
    if name == "skew":
        return F.when((n >= 3) & flat, 0.0).when(n >= 3, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))
    if name in ("kurtosis", "kurt"):
        return F.when((n >= 4) & flat, 0.0).when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))
    if name == "nunique":
        return F.when(any_row, F.count_distinct(v))
    if name == "prod":
        return F.when(any_row, F.product(v))
    if name in ("first", "last"):
        if order is None:
            raise ValueError(f"{name} needs an order")
        return (F.min_by if name == "first" else F.max_by)(v, F.when(v.isNotNull(), order))
    raise ValueError(f"unknown statistic {name}")
