"""Great-circle distance, travel speed, impossible travel (Columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_KM, MAX_HUMAN_TRAVEL_SPEED_KMH


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in km; ``a`` is clamped at 1 so asin never sees 1+eps."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    l1, l2 = F.radians(_c(lon1)), F.radians(_c(lon2))
    a = (F.pow(F.sin((p2 - p1) / 2), 2)
         + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def travel_speed_kmh(distance_km, dt_seconds) -> Column:
    """km/h; 0 when the time step is not positive or below 1e-6 hours."""
    d, t = _c(distance_km), _c(dt_seconds)
    hours = t / 3600.0
    return F.when((t <= 0) | (hours < 1e-6) | t.isNull(), F.lit(0.0)).otherwise(d / hours)


def impossible_travel(distance_km, dt_seconds,
                      max_speed_kmh: float = MAX_HUMAN_TRAVEL_SPEED_KMH) -> Column:
    t = _c(dt_seconds)
    return F.coalesce((t > 0) & (travel_speed_kmh(distance_km, dt_seconds) > max_speed_kmh),
                      F.lit(False))
