"""Parameters with their defaults, and the region predicate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

YEARS = tuple(range(2017, 2025))
IMAGERY_YEARS = tuple(range(2017, 2026))
INTERVALS = tuple(f"{a}_{a + 1}" for a in YEARS[:-1])
ALL = "all"
ENDPOINT = "endpoint"
#: The area slider, in hectares.
AREA_STEP, AREA_TOP = 0.5, 25.0


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs; those marked own are choices where nothing is published."""

    strong_change: float = 0.45
    ndvi: float = 0.0527
    active: float = 0.05
    secondary: float = 0.15
    capture_days: int = 548
    repeats: int = 2  # strong intervals that make repeated change
    cold_change: float = 0.2  # own: mean change under which a cell is cold


@dataclass(frozen=True)
class RegionFilter:
    """What a user has chosen; the defaults pass everything."""

    hotspots: bool = True
    coldspots: bool = True
    behaviour: str = ALL
    min_area: float = 0.0
    active_only: bool = False
    interval: str = ENDPOINT
    direction: str = ALL
    evidence: tuple[str, ...] = field(default=())
    match: str = ALL

    @property
    def is_active(self) -> bool:
        """Whether more than the type toggles narrows the regions, so that no stored summary fits."""
        return self.behaviour != ALL or self.min_area > 0 or self.active_only or self.direction != ALL or bool(self.evidence)

    def predicate(self, hotspot: Column | None = None, active: float = Thresholds.active) -> Column:
        """conditions() as true or false, for other uses than filters."""
        return F.coalesce(self.conditions(hotspot, active), F.lit(False))

    def conditions(self, hotspot: Column | None = None, active: float = Thresholds.active) -> Column:
        """One column for all criteria; those that pass everything are left out.

        hotspot: the share of the chosen interval; by default the wide column of it.
        Unknown types count as hot spots, a missing area as 0, a missing share or
        signal as none.  What is missing may give null, which a filter takes as
        false; so bare comparisons reach the scan.
        """
        terms = []
        cold = F.col("feature_type").eqNullSafe(F.lit("coldspot_patch"))
        if not (self.hotspots and self.coldspots):
            terms.append(~cold if self.hotspots else cold if self.coldspots else F.lit(False))
        if self.behaviour != ALL:
            terms.append(F.col("behaviour") == self.behaviour)
        if self.min_area > 0:
            terms.append(F.col("area_ha") >= self.min_area)
        if self.active_only and self.interval != ENDPOINT:
            share = hotspot if hotspot is not None else F.col(f"hotspot_{self.interval}")
            terms.append((share >= active) & ~F.isnan(share))
        if self.direction != ALL:
            terms.append(F.col("ndvi_direction") == self.direction)
        if self.evidence:
            terms.append(reduce(and_ if self.match == ALL else or_, map(F.col, self.evidence)))
        return reduce(and_, terms) if terms else F.lit(True)


def imagery_year(interval: str, years: tuple[int, ...] = IMAGERY_YEARS) -> int:
    """The year of imagery that goes with an interval: its last, within the years there are."""
    year = YEARS[-1] if interval == ENDPOINT else int(interval.split("_")[1])
    return clamped(year, years)


def clamped(year: int, years: tuple[int, ...] = IMAGERY_YEARS) -> int:
    return min(max(year, years[0]), years[-1])
