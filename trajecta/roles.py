"""Which column plays which part."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Window, WindowSpec


@dataclass(frozen=True)
class Roles:
    """pk: key of a trajectory; order: columns that put its rows in order (a time and a tie-break). Row order is never implicit."""

    pk: tuple[str, ...] = ("user_id",)
    order: tuple[str, ...] = ("t", "event_id")
    x: str = "x"
    y: str = "y"
    t: str = "t"
    duration: str | None = "duration"
    dispersion: str | None = "dispersion"
    aoi: str | None = "aoi"
    path_pk: tuple[str, ...] = ("cohort",)

    def window(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.pk, *more).orderBy(*self.order)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.pk)

    def but(self, **changes) -> Roles:
        return replace(self, **changes)
