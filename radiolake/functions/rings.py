"""Column functions on rings of layers: projection, cleaning, clipping, areas; and the area that two polygons share.

A ring is an array of (lat, lon), a polygon an array of rings. A point is in a polygon by the even-odd rule over all its
rings, so holes are rings like any other and a ring that crosses itself needs no repair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid of North America's datum, and the two parallels, origin and offsets of its census' layers.
GRS80 = (6378137.0, 1 / 298.257222101)
CENSUS = {"parallels": (49.0, 77.0), "origin": (63.390675, -91.86666666666666), "offset": (6_200_000.0, 3_000_000.0)}
#: Decimals of a degree that are kept, and points that a ring has at least, the closing one included.
DECIMALS, LEAST_POINTS = 6, 4
RING = "array<struct<lat:double,lon:double>>"


def _point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value``, which may be a long array, worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


class Conic:
    """The Lambert conformal conic projection of an ellipsoid with two standard parallels; its cone worked out once."""

    def __init__(self, parallels: tuple[float, float], origin: tuple[float, float], offset: tuple[float, float] = (0.0, 0.0), ellipsoid: tuple[float, float] = GRS80):
        self.axis, flattening = ellipsoid
        self.e = math.sqrt(flattening * (2 - flattening))
        one, two, zero = (math.radians(x) for x in (*parallels, origin[0]))
        scale = lambda p: math.cos(p) / math.sqrt(1 - (self.e * math.sin(p)) ** 2)
        self.n = math.log(scale(one) / scale(two)) / math.log(self._t(one) / self._t(two)) if one != two else math.sin(one)
        self.f = scale(one) / (self.n * self._t(one) ** self.n)
        self.r0 = self.axis * self.f * self._t(zero) ** self.n
        self.lon0, self.offset = origin[1], offset

    def _t(self, p: float) -> float:
        s = self.e * math.sin(p)
        return math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    def inverse(self, x: Column, y: Column) -> Column:
        """The point (lat, lon) at metres east and north; the latitude by six rounds, each of which adds over two digits."""
        dx, dy = x - self.offset[0], F.lit(self.r0) - (y - self.offset[1])
        sign = 1.0 if self.n > 0 else -1.0
        r = sign * F.sqrt(dx * dx + dy * dy)
        t = F.pow(r / (self.axis * self.f), F.lit(1 / self.n))

        def nearer(p: Column, _: Column) -> Column:
            s = self.e * F.sin(p)
            return math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(self.e / 2)))

        lat = F.aggregate(F.sequence(F.lit(1), F.lit(6)), math.pi / 2 - 2 * F.atan(t), nearer)
        return _point(F.degrees(lat), F.degrees(F.atan2(sign * dx, sign * dy) / self.n) + self.lon0)

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Metres east and north of a point in degrees."""
        p = F.radians(lat)
        s = self.e * F.sin(p)
        t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - s) / (1 + s), F.lit(self.e / 2))
        r = self.axis * self.f * F.pow(t, F.lit(self.n))
        turn = self.n * F.radians(lon - self.lon0)
        return r * F.sin(turn) + self.offset[0], F.lit(self.r0) - r * F.cos(turn) + self.offset[1]


def projected(ring: Column, conic: Conic) -> Column:
    """A ring of (x, y) in metres as one of (lat, lon)."""
    return F.transform(ring, lambda p: conic.inverse(p["x"], p["y"]))


def clean(ring: Column, decimals: int = DECIMALS) -> Column:
    """The ring rounded, without a point that repeats the one before it, and closed; null if it has too few points left.

    Points that come again later in the ring stay. Null points and null rings give null.
    """
    rounded = F.transform(ring, lambda p: _point(F.round(p["lat"], decimals), F.round(p["lon"], decimals)))
    same = lambda a, b: (a["lat"] == b["lat"]) & (a["lon"] == b["lon"])

    def once(r: Column) -> Column:
        marked = F.transform(r, lambda p, i: F.struct(p.alias("p"), ((i > 0) & same(F.element_at(r, F.greatest(i, F.lit(1))), p)).alias("again")))
        return F.transform(F.filter(marked, lambda x: ~x["again"]), lambda x: x["p"])

    def closed(kept: Column) -> Column:
        out = F.when(same(F.element_at(kept, 1), F.element_at(kept, -1)), kept).otherwise(F.concat(kept, F.slice(kept, 1, 1)))
        return F.when((F.size(kept) >= LEAST_POINTS - 1) & (F.size(out) >= LEAST_POINTS), out)

    return _let(rounded, lambda r: F.when(F.size(r) > 0, _let(once(r), closed)))


def clean_polygon(rings: Column, decimals: int = DECIMALS) -> Column:
    """The polygon's rings cleaned; null if the first, its outline, is lost; a lost hole is left out."""
    cleaned = F.transform(rings, lambda r: clean(r, decimals))
    return F.when(F.try_element_at(cleaned, F.lit(1)).isNotNull(), F.filter(cleaned, lambda r: r.isNotNull()))


def clipped(ring: Column, lon: float, east: bool) -> Column:
    """What of a closed ring lies east (or west) of a meridian; an empty array if nothing does.

    Each edge gives its point on the meridian, if it crosses it, and its end, if that is inside. Pieces of one ring stay one ring, joined by
    edges along the meridian that cancel out.
    """
    inside = lambda p: p["lon"] >= lon if east else p["lon"] <= lon
    none = F.array().cast(RING)

    def cut(r: Column) -> Column:
        def edge(i: Column) -> Column:
            a, b = F.element_at(r, i), F.element_at(r, i + 1)
            lat = a["lat"] + (b["lat"] - a["lat"]) * (lon - a["lon"]) / F.nullif(b["lon"] - a["lon"], F.lit(0.0))
            crossing = F.when((inside(a) != inside(b)) & (a["lon"] != lon) & (b["lon"] != lon), F.array(_point(lat, F.lit(lon)))).otherwise(none)
            return F.concat(crossing, F.when(inside(b), F.array(b)).otherwise(none))

        return F.when(F.size(r) > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.size(r) - 1), edge))).otherwise(none)

    return _let(_let(ring, cut), lambda kept: F.when(F.size(kept) > 0, F.concat(kept, F.slice(kept, 1, 1))).otherwise(kept))


def within_world(rings: Column, least_area: float = 1e-9) -> Column:
    """The polygons, one for each turn of the earth, into which the meridian of 180 degrees cuts a polygon that goes beyond it.

    Each is shifted into range; one that is in range stays as it is. Slivers of no area are left out.
    """

    def turned(shift: int) -> Column:
        moved = F.transform(rings, lambda r: F.transform(r, lambda p: _point(p["lat"], p["lon"] + shift)))
        cut = F.transform(moved, lambda r: clipped(clipped(r, -180.0, True), 180.0, False))
        return F.filter(cut, lambda r: F.size(r) >= LEAST_POINTS)

    longitudes = F.transform(F.flatten(rings), lambda p: p["lon"])
    inside = (F.array_min(longitudes) >= -180) & (F.array_max(longitudes) <= 180)
    turns = F.filter(F.array(turned(0), turned(-360), turned(360)), lambda g: (F.size(g) > 0) & (area(g) > least_area))
    return F.when(inside, F.array(rings)).otherwise(turns)


def ring_area(ring: Column) -> Column:
    """Square degrees inside a ring that doesn't cross itself."""

    def measured(r: Column) -> Column:
        # from the first point, so that the products stay small
        x, y = lambda i: F.element_at(r, i)["lon"] - F.element_at(r, 1)["lon"], lambda i: F.element_at(r, i)["lat"] - F.element_at(r, 1)["lat"]
        twice = F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda total, i: total + x(i) * y(i + 1) - x(i + 1) * y(i))
        return F.when(F.size(r) > 1, F.abs(twice) / 2).otherwise(F.lit(0.0))

    return _let(ring, measured)


def area(rings: Column) -> Column:
    """Square degrees of a polygon: its outline's less its holes', none of which cross; 0 without rings."""
    total = lambda areas: 2 * F.element_at(areas, 1) - F.aggregate(areas, F.lit(0.0), lambda sum_, a: sum_ + a)
    return F.when(F.size(rings) > 0, _let(F.transform(rings, ring_area), total)).otherwise(F.lit(0.0))


# --- the area of two polygons' intersection -----------------------------------------------------------------------

#: Pairs of a slab and an edge, or of two edges, that are worked on at once.
AT_ONCE = 1 << 20
#: Edges of pairs of polygons that are worked on at once, but at least one pair's.
EDGES_AT_ONCE = 1 << 16
POLYGON = pa.list_(pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))


def edges(polygons: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(x1, y1, x2, y2) of all edges that aren't vertical, from west to east, and the number of the polygon that each is of, in order."""
    lists = pc.list_flatten(polygons)
    ring, polygon = pc.list_parent_indices(lists).to_numpy(), pc.list_parent_indices(polygons).to_numpy()
    points = pc.list_flatten(lists)
    x, y = (points.field(f).to_numpy(zero_copy_only=False).astype(float) for f in ("lon", "lat"))
    known = np.isfinite(x) & np.isfinite(y)
    kept = np.flatnonzero((ring[1:] == ring[:-1]) & (x[1:] != x[:-1]) & known[1:] & known[:-1])
    e = np.stack([x[kept], y[kept], x[kept + 1], y[kept + 1]], axis=1)
    return np.where((e[:, 0] > e[:, 2])[:, None], e[:, [2, 3, 0, 1]], e), polygon[ring[kept]]


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def crossings(e: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where (x) two edges of one group cross, and the group; ``of`` has each edge's.

    Edges meet in strips of the width of the group's mean edge, so only near ones are compared.
    """
    if len(e) < 2:
        return np.zeros(0), of[:0]
    groups, of = np.unique(of, return_inverse=True)
    low, high = np.full(len(groups), np.inf), np.full(len(groups), -np.inf)
    np.minimum.at(low, of, e[:, 0])
    np.maximum.at(high, of, e[:, 2])
    size = np.bincount(of)
    width = np.maximum(np.maximum((high - low) / (4 * size), np.bincount(of, e[:, 2] - e[:, 0]) / size), 1e-12)
    strips = np.floor((high - low) / width).astype(np.int64) + 1
    base = (np.cumsum(strips) - strips)[of]
    first, last = (np.floor((e[:, i] - low[of]) / width[of]).astype(np.int64) for i in (0, 2))
    count = last - first + 1
    edge = np.repeat(np.arange(len(e)), count)
    strip = (base + first)[edge] + _ranges(count)
    order = np.argsort(strip, kind="stable")
    edge, strip = edge[order], strip[order]
    after = np.searchsorted(strip, strip, "right") - np.arange(len(strip)) - 1  # later edges of the same strip
    out, whose, at, ends = [], [], 0, np.cumsum(after)
    while at < len(edge):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        mine = np.arange(at, upto)
        i = np.repeat(mine, after[mine])
        j = i + 1 + _ranges(after[mine])
        a, b = e[edge[i]], e[edge[j]]
        near = (np.minimum(a[:, 1], a[:, 3]) <= np.maximum(b[:, 1], b[:, 3])) & (np.minimum(b[:, 1], b[:, 3]) <= np.maximum(a[:, 1], a[:, 3]))
        a, b = a[near], b[near]
        slope = lambda s: (s[:, 3] - s[:, 1]) / (s[:, 2] - s[:, 0])
        steeper = slope(a) - slope(b)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 0] + (b[:, 1] + slope(b) * (a[:, 0] - b[:, 0]) - a[:, 1]) / steeper
        hit = np.isfinite(x) & (x > np.maximum(a[:, 0], b[:, 0])) & (x < np.minimum(a[:, 2], b[:, 2]))
        out.append(x[hit])
        whose.append(of[edge[i[near][hit]]])
        at = upto
    return np.concatenate(out), groups[np.concatenate(whose)]


def shared_areas(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The exact area inside both polygons of each pair; ``a`` and ``b`` are arrays of polygons, lists of closed rings under the even-odd rule.

    Between two neighbouring corners or crossings, in the order of x, no two edges cross, so what both share is
    trapezoids there: their width times their height in the middle. Only edges within both outlines' range of x count.
    Pairs are worked on together, as each has few edges; one with many is worked on in parts.
    """
    (ea, of_a), (eb, of_b) = edges(a), edges(b)
    ends = np.cumsum(np.bincount(of_a, minlength=len(a)) + np.bincount(of_b, minlength=len(b)))
    out, at = [], 0
    while at < len(a):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EDGES_AT_ONCE, "right")))
        (i, j), (k, m) = (np.searchsorted(of, [at, upto]) for of in (of_a, of_b))
        out.append(_shared(np.concatenate([ea[i:j], eb[k:m]]), np.concatenate([of_a[i:j], of_b[k:m]]) - at, np.arange(j - i + m - k) < j - i, upto - at))
        at = upto
    return np.concatenate(out) if out else np.zeros(0)


def _shared(e: np.ndarray, of: np.ndarray, of_a: np.ndarray, pairs: int) -> np.ndarray:
    """The shared area of each pair, from all edges, their pairs, and whether they are the first polygon's."""
    low, high = np.full(pairs, -np.inf), np.full(pairs, np.inf)
    for side in (of_a, ~of_a):
        west, east = np.full(pairs, np.inf), np.full(pairs, -np.inf)
        np.minimum.at(west, of[side], e[side, 0])
        np.maximum.at(east, of[side], e[side, 2])
        low, high = np.maximum(low, west), np.minimum(high, east)
    kept = (low < high)[of] & (e[:, 2] > low[of]) & (e[:, 0] < high[of])
    e, of, of_a = e[kept], of[kept], of_a[kept]
    total = np.zeros(pairs)
    if not len(e):
        return total
    met, whose = crossings(e, of)
    # all stops by pair and x; edges know the numbers of those where they begin and end
    x = np.concatenate([np.maximum(e[:, 0], low[of]), np.minimum(e[:, 2], high[of]), np.clip(met, low[whose], high[whose])])
    pair = np.concatenate([of, of, whose])
    order = np.lexsort((x, pair))
    new = np.r_[True, (pair[order][1:] != pair[order][:-1]) | (x[order][1:] != x[order][:-1])]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    stops, pair = x[order][new], pair[order][new]
    first, last = number[: len(e)], number[len(e) : 2 * len(e)]
    # what lies between two pairs is no slab: no edge is over it
    middle, wide = (stops[:-1] + stops[1:]) / 2, np.diff(stops)
    # edges over each slab, so that a part of the slabs is worked on at once
    over = np.cumsum(np.bincount(first, minlength=len(stops)) - np.bincount(last, minlength=len(stops)))[:-1]
    at, ends = 0, np.cumsum(over)
    while at < len(middle):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        own = np.flatnonzero((first < upto) & (last > at))
        begin, stop = np.maximum(first[own], at), np.minimum(last[own], upto)
        count = stop - begin
        edge = np.repeat(own, count)
        slab = np.repeat(begin, count) + _ranges(count)
        y = e[edge, 1] + (e[edge, 3] - e[edge, 1]) * (middle[slab] - e[edge, 0]) / (e[edge, 2] - e[edge, 0])
        order = np.lexsort((y, slab))
        slab, y, mine = slab[order], y[order], of_a[edge][order]
        # crossed so far in the slab, of either polygon
        begun = np.searchsorted(slab, slab)
        inside = lambda m: (np.cumsum(m) - (np.cumsum(m) - m)[begun]) % 2 == 1
        both = inside(mine)[:-1] & inside(~mine)[:-1] & (slab[1:] == slab[:-1])
        height = np.where(both, np.diff(y), 0.0)
        total += np.bincount(pair[slab[:-1]], height * wide[slab[:-1]], minlength=pairs)
        at = upto
    return total


def shared_area(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """The same for one pair, each a list of closed arrays of (x, y)."""
    one = lambda rings: pa.array([[[{"lat": y, "lon": x} for x, y in r] for r in rings]], POLYGON)
    return float(shared_areas(one(a), one(b))[0])
