"""Reports over trajectories and labels, topology curves, and results kept on disk."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators.maps import persistence_curve, rips_diagram
from trajecta.roles import Roles


def length_report(df: DataFrame, roles: Roles) -> DataFrame:
    """One row: number of trajectories, and mean, deviation (of the population), least and most of their rows and total durations."""
    each = df.dropna(subset=list(roles.pk)).groupBy(*roles.pk).agg(F.count("*").alias("rows"), F.sum(roles.duration or F.lit(0.0)).alias("duration"))
    made = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return each.agg(F.count("*").alias("trajectories"), *[f(c).alias(f"{c}_{n}") for c in ("rows", "duration") for n, f in made.items()])


def varied_labels(df: DataFrame, labels: Sequence[str], least: int = 2) -> list[str]:
    """The labels with at least so many distinct values that are not null."""
    row = df.agg(*[F.count_distinct(c).alias(c) for c in labels]).first()
    return [c for c in labels if row[c] >= least]


def override_normalization(fitted: DataFrame, key: str, column: str, mean: Mapping | None = None, std: Mapping | None = None) -> DataFrame:
    """Fitted means and deviations (see tables.fit_normalization) of column with those of some groups given."""
    out = fitted
    for kind, given in (("mean", mean), ("std", std)):
        for group, value in (given or {}).items():
            name = f"__{kind}_{column}"
            out = out.withColumn(name, F.when(F.col(key) == F.lit(group), F.lit(float(value))).otherwise(F.col(name)))
    return out


def topological_features(df: DataFrame, roles: Roles, max_radius: float = 1.0, max_time: float = 1.0, time_steps: int = 100, max_points: int | None = None) -> DataFrame:
    """(pk, time, curve, entropy) of the bars of the Vietoris-Rips filtration. Bars without end, which would make every value infinite, are left out."""
    bars = rips_diagram(df, roles, max_radius, max_points)
    times = [max_time * k / max(1, time_steps - 1) for k in range(time_steps)]
    keys = list(roles.pk)
    curve = persistence_curve(bars, keys, times).withColumnRenamed("value", "curve")
    return curve.join(persistence_curve(bars, keys, times, True).withColumnRenamed("value", "entropy"), [*keys, "time"])


def saved(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was written whole before; otherwise make() is written there first."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
