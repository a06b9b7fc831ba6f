"""Column functions on WGS-84 coordinates: grids, distances, bearings, unit vectors, points in rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The earth's radius in kilometres and in miles, the letters of grid fields, units of a degree in a prefix list.
EARTH_KM, EARTH_MILES = 6371.0, 3958.8
FIELD = "ABCDEFGHIJKLMNOPQR"
PREFIX_UNITS = 180
#: Kilometres of a degree along a great circle.
KM_A_DEGREE = 111.19


def valid(lat: Column, lon: Column) -> Column:
    """Is it a coordinate: both there, numbers, in range."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)


def west(lon: Column) -> Column:
    """The date line is at -180, never at +180."""
    return F.when(lon == 180, F.lit(-180.0)).otherwise(lon)


def maidenhead(lat: Column, lon: Column) -> Column:
    """Four-character grid square; the far edges belong to the last square. Null without a position."""
    y, x = F.least(lat + 90, F.lit(179.999999)), F.least(lon + 180, F.lit(359.999999))
    letter = lambda v: F.substring(F.lit(FIELD), (F.floor(v) + 1).cast("int"), F.lit(1))
    digit = lambda v: F.floor(v).cast("int").cast("string")
    square = F.concat(letter(x / 20), letter(y / 10), digit((x % 20) / 2), digit(y % 10))
    return F.when(lat.isNotNull() & lon.isNotNull(), square)


def grid_center(grid: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a four-character square."""
    place = lambda i: F.instr(F.lit(FIELD), F.substring(grid, i, 1)) - 1
    digit = lambda i: F.substring(grid, i, 1).cast("int")
    return (place(2) * 10 + digit(4) - 90 + F.lit(0.5)), (place(1) * 20 + digit(3) * 2 - 180 + F.lit(1.0))


def central_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle between two points as seen from the earth's middle, in radians."""
    dy, dx = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dy / 2) * F.sin(dy / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dx / 2) * F.sin(dx / 2)
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def kilometres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in whole kilometres, rounded down."""
    return F.floor(EARTH_KM * central_angle(lat1, lon1, lat2, lon2)).cast("long")


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in whole miles, rounded half up, as a double: not a number stays so."""
    far = EARTH_MILES * central_angle(lat1, lon1, lat2, lon2)
    return F.when(F.isnan(far), far).otherwise(F.floor(far + 0.5).cast("double"))


def prefix_degrees(units: Column) -> Column:
    """A prefix list's whole-number coordinate in degrees."""
    return units / F.lit(float(PREFIX_UNITS))


def coordinates(pair: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a text ``lat,lon``; null where they can't be read."""
    part = lambda i: F.trim(F.try_element_at(F.split(pair, ",", 2), F.lit(i))).try_cast("double")
    return part(1), part(2)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in whole degrees, 0 to 359."""
    dx = F.radians(lon2 - lon1)
    y = F.sin(dx) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dx)
    return F.pmod(F.floor(F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)) + 0.5), F.lit(360)).cast("long")


def unit(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point on the unit sphere."""
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def in_ring(ring: Column, lat: Column, lon: Column) -> Column:
    """Even-odd rule for one closed ring, an array of (lat, lon); how often a ray to the east crosses it."""

    def crossed(n: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        hit = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return n + F.when(hit & (lon < at), 1).otherwise(0)

    return F.when(F.size(ring) < 4, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0), crossed))


def in_polygon(rings: Column, lat: Column, lon: Column) -> Column:
    """Even-odd rule over all rings: holes are rings like any other."""
    return F.aggregate(rings, F.lit(0), lambda n, ring: n + in_ring(ring, lat, lon)) % 2 == 1


def ring_distance(ring: Column, lat: Column, lon: Column) -> Column:
    """Distance in degrees, on the plane, from a point to the nearest edge of a ring."""

    def to_edge(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        dy, dx = b["lat"] - a["lat"], b["lon"] - a["lon"]
        along = ((lat - a["lat"]) * dy + (lon - a["lon"]) * dx) / F.nullif(dy * dy + dx * dx, F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
        y, x = a["lat"] + t * dy - lat, a["lon"] + t * dx - lon
        return F.sqrt(y * y + x * x)

    return F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), to_edge))


def distance(rings: Column, lat: Column, lon: Column) -> Column:
    """0 inside a polygon, else the distance in degrees to its nearest ring."""
    return F.when(in_polygon(rings, lat, lon), F.lit(0.0)).otherwise(F.array_min(F.transform(rings, lambda r: ring_distance(r, lat, lon))))
