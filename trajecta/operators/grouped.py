"""Grouped kernels: one exchange by key, one sort, and one numpy function for each trajectory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.roles import Roles


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def spread(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """df dealt out by keys to a stated number of partitions: by default the session's shuffle partitions, and at least two for each core.

    What kernels cost depends on rows and their work and not on bytes, by which Spark would put small partitions together.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def trajectories(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """The rows of each key, of batches that are sorted by it, and whether they are the last that end in a batch. Only the key that is still open is kept from batch to batch."""
    open_: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        values = [pdf[k].to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        edges = [0, *cut.tolist(), len(pdf)]
        if open_ and any(open_[-1][k].iloc[-1] != v[0] for k, v in zip(keys, values, strict=True)):
            yield pd.concat(open_, ignore_index=True), len(edges) == 2
            open_ = []
        for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True), 3):
            open_.append(pdf.iloc[a:b])
            if b < len(pdf):
                yield open_[0].reset_index(drop=True) if len(open_) == 1 else pd.concat(open_, ignore_index=True), n == len(edges)
                open_ = []
    if open_:
        yield pd.concat(open_, ignore_index=True), True


def per_trajectory(df: DataFrame, roles: Roles, columns: Sequence[str], f: Callable[[pd.DataFrame], pd.DataFrame | dict], schema: str, keys: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """f gets a trajectory's columns (only those asked for) in order, and returns rows of schema, or one row as a dict of numbers; its key is put in front. partitions: see spread.

    Rows come sorted, and many trajectories in one batch: a batch for each would cost more than most kernels.
    """
    keys = list(keys or roles.pk)
    wanted = list(dict.fromkeys([*keys, *roles.order, *columns]))
    order = list(roles.order)
    rows = spread(df.dropna(subset=keys).select(*wanted), keys, partitions)
    out_schema = f"{key_schema(df, keys)}, {schema}"

    def keyed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf)
        if isinstance(out, dict):
            out = pd.DataFrame([out]).astype(float)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0], allow_duplicates=True) if k not in out else None
        return out

    if any(t not in ("bigint", "int", "smallint", "tinyint", "string", "boolean", "date") for k, t in df.dtypes if k in keys):
        # of such keys equal ones may differ as they are read: 0.0 and -0.0, nan
        return rows.groupBy(*keys).applyInPandas(lambda pdf: keyed(pdf.sort_values(order, kind="stable").reset_index(drop=True)), out_schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single, frames, n = [], [], 0
        for pdf, last in trajectories(batches, keys):
            out = f(pdf)
            if isinstance(out, dict):
                single.append({k: pdf[k].iloc[0] for k in keys} | out)
            elif len(out):
                for i, k in enumerate(keys):
                    out.insert(i, k, pdf[k].iloc[0], allow_duplicates=True) if k not in out else None
                frames.append(out)
                n += len(out)
            if last or n > 10_000:
                if single:
                    made = pd.DataFrame(single)
                    yield made.astype({c: float for c in made.columns if c not in keys})
                if frames:
                    yield pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
                single, frames, n = [], [], 0

    return rows.sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order]).mapInPandas(run, out_schema)


class Kernel:
    """A function of a trajectory that gives numbers: names and compute(x, y, t, pdf)."""

    def __init__(self, names: Sequence[str], compute: Callable[..., Sequence[float]], columns: Sequence[str] = ()) -> None:
        self.names, self.compute, self.columns = list(names), compute, list(columns)


def _finite(v: float) -> float | None:
    return float(v) if v is not None and np.isfinite(v) else None


def run_kernels(df: DataFrame, roles: Roles, kernels: Sequence[Kernel]) -> DataFrame:
    """All kernels in one pass. Undefined results (errors on short input, infinite values) are null."""

    def f(pdf: pd.DataFrame) -> dict:
        x, y, t = (pdf[c].to_numpy(float) for c in (roles.x, roles.y, roles.t))
        row: dict[str, float | None] = {}
        for k in kernels:
            try:
                with np.errstate(all="ignore"):
                    values = k.compute(x, y, t, pdf)
            except (ValueError, IndexError, ZeroDivisionError, FloatingPointError, np.linalg.LinAlgError):
                values = [None] * len(k.names)
            row.update(zip(k.names, map(_finite, values), strict=True))
        return row

    names = [n for k in kernels for n in k.names]
    columns = [roles.x, roles.y, roles.t, *[c for k in kernels for c in k.columns]]
    return per_trajectory(df, roles, columns, f, ", ".join(f"`{n}` double" for n in names))
