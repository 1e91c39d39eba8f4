"""Geography on latitude and longitude Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, KM_A_DEGREE = 6371.0, 111.0


def distance_km(lat: Column, lon: Column, lat2, lon2) -> Column:
    """Great-circle distance by the haversine formula."""
    lat2, lon2 = F.lit(lat2) if not isinstance(lat2, Column) else lat2, F.lit(lon2) if not isinstance(lon2, Column) else lon2
    a = F.pow(F.sin(F.radians(lat2 - lat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing(lat: Column, lon: Column, lat2, lon2) -> Column:
    """Initial bearing in degrees from north, 0 to 360."""
    a, b, d = F.radians(lat), F.radians(F.lit(lat2)), F.radians(F.lit(lon2) - lon)
    turn = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(turn + 360.0, F.lit(360.0))


def inside(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def kilometres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Distance of two literals, on the driver."""
    f1, f2, dl = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
    a = math.sin((f2 - f1) / 2) ** 2 + math.cos(f1) * math.cos(f2) * math.sin(dl / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, a)))


@dataclass(frozen=True)
class Box:
    """A box that does not cross the antimeridian."""

    north: float
    west: float
    south: float
    east: float

    def __post_init__(self):
        if self.south > self.north or self.west > self.east:
            raise ValueError("a box needs south <= north and west <= east")

    @property
    def centre(self) -> tuple[float, float]:
        return (self.north + self.south) / 2, (self.west + self.east) / 2

    @property
    def dimensions_km(self) -> tuple[float, float]:
        lat, lon = self.centre
        return kilometres(lat, self.west, lat, self.east), kilometres(self.south, lon, self.north, lon)

    @property
    def farthest_km(self) -> float:
        """From the centre to the farthest corner."""
        lat, lon = self.centre
        return max(kilometres(lat, lon, y, x) for y in (self.south, self.north) for x in (self.west, self.east))


def around(lat: float, lon: float, km: float) -> tuple[float, float, float, float]:
    """South, north, west, east of a box that holds the circle: a cheap filter that reaches the scan."""
    dy = km / KM_A_DEGREE + 0.01
    widest = min(89.9, max(abs(lat - dy), abs(lat + dy)))
    dx = 180.0 if abs(lat) + dy >= 89.9 else min(180.0, km / (KM_A_DEGREE * math.cos(math.radians(widest))) + 0.01)
    west, east = lon - dx, lon + dx
    return (lat - dy, lat + dy, -180.0, 180.0) if west < -180 or east > 180 else (lat - dy, lat + dy, west, east)
