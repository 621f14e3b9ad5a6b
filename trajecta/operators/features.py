"""Statistics of steps (saccades), returns (regressions), small steps and stops (fixations), as declarative parts.

A part says which row columns it needs and which aggregates it makes; plans.Extractor compiles many parts into one
window pass and one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.functions.aggregates import stat
from trajecta.functions.geometry import angle, asymmetric_normal, in_ranges
from trajecta.roles import Roles

DEFAULT = ("min", "max", "mean", "std")
EPS = 1e-20


def step_columns(df: DataFrame, roles: Roles, suffix: str = "", *within: str) -> DataFrame:
    """Adds for each row its step from the one before: dx, dy, dt, length, direction_angle, speed, acceleration, rotation_angle.

    With a duration (milliseconds) dt runs from the end of the row before, otherwise it is 0.999 of the difference of
    times. within: further keys of the sequence, such as an area of interest.
    """
    w = roles.window(*within)
    before = F.lag(F.col(roles.t) + F.col(roles.duration) / 1000).over(w) if roles.duration else None
    gap = F.col(roles.t) - F.lag(roles.t).over(w)
    n = {k: f"__{k}{suffix}" for k in ("dx", "dy", "dt", "length", "direction_angle", "speed", "acceleration", "rotation_angle")}
    df = df.withColumns({n["dx"]: F.col(roles.x) - F.lag(roles.x).over(w), n["dy"]: F.col(roles.y) - F.lag(roles.y).over(w), n["dt"]: (F.col(roles.t) - before) if roles.duration else gap - gap / 1000})
    df = df.withColumns({n["length"]: F.sqrt(F.col(n["dx"]) ** 2 + F.col(n["dy"]) ** 2), n["direction_angle"]: angle(F.col(n["dx"]), F.col(n["dy"]))})
    dt, length = F.col(n["dt"]), F.col(n["length"])
    return df.withColumns({n["speed"]: F.try_divide(length, dt + EPS), n["acceleration"]: F.try_divide(length, dt * dt + EPS) / 2, n["rotation_angle"]: F.abs(F.col(n["direction_angle"]) - F.lag(n["direction_angle"]).over(w))})


@dataclass(frozen=True)
class StatsPart:
    """stats: feature -> statistics. areas: values of the aoi column to report apart; without_areas keeps the totals too."""

    stats: dict[str, Sequence[str]] = field(default_factory=dict)
    areas: Sequence[str] = ()
    without_areas: bool = True
    prefix = ""
    features = ()

    def __post_init__(self) -> None:
        if bad := set(self.stats) - set(self.features):
            raise ValueError(f"unknown features {sorted(bad)}")

    def value(self, feature: str, suffix: str, roles: Roles) -> Column:
        return F.col(f"__{feature}{suffix}")

    def chosen(self, feature: str, suffix: str, roles: Roles) -> Column | None:
        return None

    def aggregates(self, roles: Roles) -> list[Column]:
        out, order = [], F.struct(*roles.order)
        spec = self.stats or {f: DEFAULT for f in self.features if f != "mask"}
        for feature, names in spec.items():
            if self.without_areas or not self.areas:
                for s in names:
                    out.append(stat(s, self.value(feature, "", roles), self.chosen(feature, "", roles), order).alias(f"{self.prefix}_{feature}_{s}"))
            for area in self.areas:
                inside = F.col(roles.aoi) == F.lit(area)
                if feature != "mask":
                    inside = inside & F.coalesce(F.col("__same_aoi"), F.lit(False))
                own = self.chosen(feature, "_in", roles)
                for s in names:
                    out.append(stat(s, self.value(feature, "_in", roles), inside if own is None else inside & own, order).alias(f"{self.prefix}_{feature}_{roles.aoi}[{area}]_{s}"))
        return out


@dataclass(frozen=True)
class SaccadeFeatures(StatsPart):
    prefix = "sac"
    features = ("length", "acceleration", "speed", "direction_angle", "rotation_angle")


@dataclass(frozen=True)
class RegressionFeatures(StatsPart):
    """Steps whose direction lies in any of the ranges; mask is 0 or 1 over all rows."""

    ranges: Sequence[tuple[float, float]] = ((135, 225),)
    prefix = "reg"
    features = ("length", "acceleration", "speed", "direction_angle", "rotation_angle", "mask")

    def value(self, feature: str, suffix: str, roles: Roles) -> Column:
        if feature == "mask":
            return in_ranges(F.col(f"__direction_angle{suffix}"), self.ranges).cast("double")
        return super().value(feature, suffix, roles)

    def chosen(self, feature: str, suffix: str, roles: Roles) -> Column | None:
        return None if feature == "mask" else in_ranges(F.col(f"__direction_angle{suffix}"), self.ranges)


@dataclass(frozen=True)
class MicroSaccadeFeatures(StatsPart):
    """Steps shorter than max_speed (a length) at rows whose dispersion is above min_dispersion."""

    min_dispersion: float = 1.0
    max_speed: float = 10.0
    prefix = "microsac"
    features = ("length", "acceleration", "speed", "direction_angle", "rotation_angle", "mask")

    def chosen(self, feature: str, suffix: str, roles: Roles) -> Column | None:
        test = F.coalesce((F.col(f"__length{suffix}") < self.max_speed) & (F.col(roles.dispersion) > self.min_dispersion), F.lit(False))
        return None if feature == "mask" else test

    def value(self, feature: str, suffix: str, roles: Roles) -> Column:
        if feature == "mask":
            return F.coalesce((F.col(f"__length{suffix}") < self.max_speed) & (F.col(roles.dispersion) > self.min_dispersion), F.lit(False)).cast("double")
        return super().value(feature, suffix, roles)


@dataclass(frozen=True)
class FixationFeatures(StatsPart):
    prefix = "fix"
    features = ("duration", "vad")

    def value(self, feature: str, suffix: str, roles: Roles) -> Column:
        return F.col(roles.duration if feature == "duration" else roles.dispersion)


@dataclass(frozen=True)
class SaccadeUnlikelihood:
    """Negative log likelihood of step lengths under a mixture of forward and backward steps; 30 where it vanishes."""

    mu_p: float = 1.0
    sigma_p1: float = 0.5
    sigma_p2: float = 1.0
    mu_r: float = 1.0
    sigma_r1: float = 0.3
    sigma_r2: float = 0.7
    psi: float = 0.9

    def aggregates(self, roles: Roles) -> list[Column]:
        v = F.col("__length")
        p = self.psi * asymmetric_normal(v, self.mu_p, self.sigma_p1, self.sigma_p2) + (1 - self.psi) * asymmetric_normal(v, self.mu_r, self.sigma_r1, self.sigma_r2)
        return [F.sum(F.when(v.isNull(), 0.0).when(p > 1e-15, -F.ln(p)).otherwise(30.0)).alias("saccade_nll")]


@dataclass(frozen=True)
class SpectralEntropy:
    """Of the shares of x^2 + y^2."""

    def aggregates(self, roles: Roles) -> list[Column]:
        r = F.col(roles.x) ** 2 + F.col(roles.y) ** 2
        total = F.sum(r)
        return [F.when(total > 0, F.ln(total) - F.sum(F.when(r > 0, r * F.ln(r)).otherwise(0.0)) / total).alias("spectral_entropy")]
