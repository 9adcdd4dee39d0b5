"""Column expressions for codes, times, places and magnitudes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres per degree of latitude.
KM_PER_DEGREE = 111.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code(c: Column | str) -> Column:
    """A code in upper case without surrounding blanks; an empty code is null."""
    text = F.upper(F.regexp_replace(col(c), r"^\s+|\s+$", ""))
    return F.when(text != "", text)


def micros(c: Column | str) -> Column:
    """Microseconds since 1970, also for timestamps without a zone (read as session time, UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def east(lon: Column | str) -> Column:
    """Longitude on -180..180; 242.5 becomes -117.5."""
    x = col(lon)
    return F.when(x > 180, x - 360).otherwise(x)


def origin_time(tp: Column, ts: Column, vp: float = 6.0, vs: float = 3.45) -> Column:
    """Origin time (in the unit of the inputs) from the S minus P delay on straight rays."""
    return tp - (ts - tp) / (1.0 / vs - 1.0 / vp) / vp


def plane_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, at: Column | None = None) -> Column:
    """Horizontal distance on the local plane; longitude is scaled by the cosine of ``at`` (default ``lat2``)."""
    dx = KM_PER_DEGREE * (lon1 - lon2) * F.cos(F.radians(lat2 if at is None else at))
    dy = KM_PER_DEGREE * (lat1 - lat2)
    return F.sqrt(dx * dx + dy * dy)


def hypo_km(lat: Column, lon: Column, dep: Column, sta_lat: Column, sta_lon: Column, ele_m: Column) -> Column:
    """Distance from a source at depth ``dep`` km to a station at ``ele_m`` metres."""
    flat = plane_km(lat, lon, sta_lat, sta_lon)
    dz = dep + ele_m / 1000.0
    return F.sqrt(flat * flat + dz * dz)


def station_magnitude(amp: Column, dist_km: Column) -> Column:
    """Local magnitude of one station; null for an amplitude or distance that is not above zero."""
    ok = (amp > 0) & (dist_km > 0)
    return F.when(ok, F.log10(amp * 1e6) + F.log10(dist_km) + 1.0)
