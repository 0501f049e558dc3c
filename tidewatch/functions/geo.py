"""Points on the sphere: validity, distance and the grid that makes a distance join an equi-join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_010.0


def wrap_longitude(lon: Column) -> Column:
    """Longitude brought into [-180, 180]; values already inside are returned unchanged."""
    return F.when(lon.between(-180.0, 180.0), lon).otherwise(lon - F.floor((lon + 180.0) / 360.0) * 360.0)


def checked_latitude(lat: Column, on_bad: str = "fail") -> Column:
    """Latitude in [-90, 90]. Anything else fails the job, or becomes NULL with ``on_bad="null"``."""
    if on_bad not in ("fail", "null"):
        raise ValueError(f"on_bad must be 'fail' or 'null', not {on_bad!r}")
    bad = (
        F.raise_error(F.concat(F.lit("latitude out of range: "), lat.cast("string"))).cast("double")
        if on_bad == "fail"
        else F.lit(None).cast("double")
    )
    return F.when(~lat.between(-90.0, 90.0), bad).otherwise(lat)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    sin_lat = F.sin(F.radians(lat2 - lat1) / 2)
    sin_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lon * sin_lon
    return F.asin(F.least(F.lit(1.0), F.sqrt(chord))) * (2 * EARTH_RADIUS_M)


class Grid:
    """Cells at least one radius wide in both directions, at every latitude.

    The sphere is cut into bands of equal height, and each band into as many cells as fit at that latitude.
    A point lies in one cell. A site lists the cells its circle can reach: up to three bands and a handful of
    cells in each, also at the poles, where a band has only a few cells. So a point and a site within the
    radius meet in exactly one cell, the point's own, and an equi-join on the cell finds each pair once.
    """

    def __init__(self, radius_m: float):
        if not radius_m > 0:
            raise ValueError("the radius must be positive")
        # 0.1 % margin over the exact angle, so that rounding never loses a pair; the exact distance decides.
        self.step = min(180.0, max(1e-6, 1.001 * math.degrees(radius_m / EARTH_RADIUS_M)))
        self.bands = math.floor(180.0 / self.step) + 1
        self.stride = math.floor(360.0 / self.step) + 2

    def _band(self, lat: str) -> str:
        return f"floor(({lat} + 90D) / {self.step!r}D)"

    def _cells_in_band(self) -> str:
        """How many cells the band in column _band has: a function of the band alone, so both join sides agree."""
        low = f"(_band * {self.step!r}D - 90D)"
        nearest_equator = f"least(abs({low}), abs({low} + {self.step!r}D), 90D)"
        return f"greatest(1L, floor(cos(radians({nearest_equator})) * 360D / {self.step!r}D))"

    def with_cell(self, df: DataFrame, name: str) -> DataFrame:
        """Add the one cell the point (lon, lat) of each row lies in, as a BIGINT that is never NULL.

        Band and cell count are columns of their own first: used several times, they are computed once. And a
        key that cannot be NULL spares the optimizer a null filter that would repeat the whole expression.
        """
        return (
            df.selectExpr("*", f"{self._band('lat')} AS _band")
            .selectExpr("*", f"{self._cells_in_band()} AS _count")
            .select(
                *df.columns,
                F.expr(
                    f"coalesce(_band * {self.stride}L + pmod(floor((lon + 180D) * _count / 360D), _count), -1L)"
                ).alias(name),
            )
        )

    def with_reachable_cells(self, df: DataFrame, lon: str, lat: str, name: str) -> DataFrame:
        """Each row once per cell that a circle around its point can touch."""
        step = f"{self.step!r}D"
        lowest, highest = self._band(f"({lat} - {step})"), self._band(f"({lat} + {step})")
        reach = f"least(180D, {step} / greatest(cos(radians(least(90D, abs({lat}) + {step}))), 1e-9D))"
        return (
            df.selectExpr("*", f"explode(sequence(greatest(0L, {lowest}), least({self.bands}L, {highest}))) AS _band")
            .selectExpr("*", f"{self._cells_in_band()} AS _count", f"{reach} AS _reach")
            .selectExpr(
                "*",
                f"floor(({lon} - _reach + 180D) * _count / 360D) AS _first",
                f"floor(({lon} + _reach + 180D) * _count / 360D) AS _last",
            )
            # At most _count consecutive indexes, so none repeats after wrapping around the globe.
            .selectExpr("*", "explode(sequence(_first, least(_last, _first + _count - 1))) AS _index")
            .selectExpr(*df.columns, f"_band * {self.stride}L + pmod(_index, _count) AS {name}")
        )
