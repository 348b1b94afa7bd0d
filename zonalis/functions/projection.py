"""Lambert conformal conic (two standard parallels) as native column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Conic:
    """An ellipsoidal LCC-2SP system; angles in degrees, lengths in metres."""

    lat0: float
    lon0: float
    parallel1: float
    parallel2: float
    false_east: float
    false_north: float
    semi_major: float
    inverse_flattening: float

    @property
    def ecc(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    def _m(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1 - (self.ecc * s) ** 2)

    def _t(self, lat: float) -> float:
        e, s = self.ecc, math.sin(math.radians(lat))
        return math.tan(math.pi / 4 - math.radians(lat) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

    @property
    def cone(self) -> float:
        return (math.log(self._m(self.parallel1)) - math.log(self._m(self.parallel2))) / (
            math.log(self._t(self.parallel1)) - math.log(self._t(self.parallel2))
        )

    @property
    def scale(self) -> float:
        return self.semi_major * self._m(self.parallel1) / (self.cone * self._t(self.parallel1) ** self.cone)

    @property
    def rho0(self) -> float:
        return self.scale * self._t(self.lat0) ** self.cone


#: EPSG:6372 (Mexico ITRF2008 / LCC) on GRS80, the public parameters of the registry.
EPSG_6372 = Conic(12.0, -102.0, 17.5, 29.5, 2_500_000.0, 0.0, 6_378_137.0, 298.257222101)


def forward(lon: Column, lat: Column, crs: Conic = EPSG_6372) -> tuple[Column, Column]:
    """(x, y) of geographic degrees; null in, null out."""
    phi, e = F.radians(lat), crs.ecc
    es = F.sin(phi) * e
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(e / 2))
    rho = F.pow(t, F.lit(crs.cone)) * crs.scale
    theta = F.radians(lon - crs.lon0) * crs.cone
    return rho * F.sin(theta) + crs.false_east, F.lit(crs.rho0 + crs.false_north) - rho * F.cos(theta)


def inverse(x: Column, y: Column, crs: Conic = EPSG_6372, steps: int = 6) -> tuple[Column, Column]:
    """(lon, lat) in degrees of plane coordinates; `steps` fixed-point rounds reach about 1e-11 rad."""
    e, dx, dy = crs.ecc, x - crs.false_east, F.lit(crs.rho0 + crs.false_north) - y
    rho, theta = F.sqrt(dx * dx + dy * dy), F.atan2(dx, dy)
    t = F.pow(rho / crs.scale, F.lit(1 / crs.cone))
    phi = F.lit(math.pi / 2) - F.atan(t) * 2
    for _ in range(steps):
        es = F.sin(phi) * e
        phi = F.lit(math.pi / 2) - F.atan(t * F.pow((1 - es) / (1 + es), F.lit(e / 2))) * 2
    return F.degrees(theta / crs.cone) + crs.lon0, F.degrees(phi)
