"""Rings and polygons: areas, projection against published points, cleaning, the date line, nearest parts."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from radiolake.functions import rings
from radiolake.operators import spatial

RINGS = f"array<{rings.RING}>"


def box(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def struct(ring):
    return [(float(lat), float(lon)) for lon, lat in ring]


def star(rng, n, x, y, size):
    turn, far = np.sort(rng.random(n)) * 2 * math.pi, rng.uniform(size / 3, size, n)
    ring = np.stack([x + far * np.cos(turn), y + far * np.sin(turn)], axis=1)
    return np.concatenate([ring, ring[:1]])


def inside(polygon, points):
    crossed = np.zeros(len(points), int)
    for ring in polygon:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
            if y1 != y2:
                hit = (y1 > points[:, 1]) != (y2 > points[:, 1])
                crossed += hit & (points[:, 0] < (x2 - x1) * (points[:, 1] - y1) / (y2 - y1) + x1)
    return crossed % 2 == 1


def test_areas_by_hand():
    array = lambda *r: [np.array(x, float) for x in r]
    assert rings.shared_area(array(box(0, 0, 10), box(2, 2, 6)), array(box(0, 0, 10))) == 64
    assert rings.shared_area(array(box(0, 0, 2)), array(box(1, 1, 2))) == 1
    assert rings.shared_area(array(box(0, 0, 2)), array(box(2, 0, 2))) == rings.shared_area([], array(box(0, 0, 1))) == 0
    tie = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]  # crosses itself: two triangles
    assert rings.shared_area(array(tie), array(box(0, 0, 2))) == 2
    assert rings.shared_area(array([(0, 0), (2, 0), (0, 2), (0, 0)]), array([(1, 0), (3, 0), (1, 2), (1, 0)])) == pytest.approx(0.5)


def test_areas_by_many_points(monkeypatch):
    rng = np.random.default_rng(1)
    points = rng.uniform(-4, 4, (300_000, 2))
    for _ in range(3):
        a, b = [star(rng, 30, 0, 0, 3), star(rng, 9, 0, 0, 0.8)], [star(rng, 25, 1, 0.5, 3)]
        whole = rings.shared_area(a, b)
        assert whole == pytest.approx((inside(a, points) & inside(b, points)).mean() * 64, abs=0.1)
        monkeypatch.setattr(rings, "AT_ONCE", 7)  # the same in small parts
        assert rings.shared_area(a, b) == pytest.approx(whole, abs=1e-9)
        monkeypatch.undo()


def test_projection_against_published_points(spark):
    """An ellipsoidal example of a manual of map projections (Clarke's of 1866, 33 and 45 degrees), and the census' own origin."""
    clarke = rings.Conic((33.0, 45.0), (23.0, -96.0), ellipsoid=(6378206.4, 1 / 294.978698))
    census = rings.Conic(**rings.CENSUS)
    df = spark.createDataFrame([(1894410.9, 1564649.5, 6_200_000.0, 3_000_000.0)], "x double, y double, u double, v double")
    got = df.select(clarke.inverse(F.col("x"), F.col("y")).alias("a"), census.inverse(F.col("u"), F.col("v")).alias("b")).first()
    assert tuple(got["a"]) == pytest.approx((35.0, -75.0), abs=1e-6) and tuple(got["b"]) == pytest.approx((63.390675, -91.866667), abs=1e-6)
    east, north = spark.range(1).select(*clarke.forward(F.lit(35.0), F.lit(-75.0))).first()
    assert (east, north) == pytest.approx((1894410.9, 1564649.5), abs=0.1)


def test_rings_are_cleaned(spark):
    given = [
        [(0, 0), (1, 0), (1, 0), (1, 1)],  # repeats, isn't closed
        [(0, 0), (1, 0), (0, 1), (1, 0), (0, 0)],  # a point that comes again stays
        [(0, 0), (1e-9, 0), (0, 1e-9)],
        [(0, 0), (1, 1)],
        [],
        None,
    ]
    df = spark.createDataFrame([(i, None if r is None else struct(r)) for i, r in enumerate(given)], f"i int, r {rings.RING}")
    got = [r["c"] for r in df.select("i", rings.clean(F.col("r")).alias("c")).orderBy("i").collect()]
    assert [None if r is None else [(p["lon"], p["lat"]) for p in r] for r in got] == [[(0, 0), (1, 0), (1, 1), (0, 0)], [(0, 0), (1, 0), (0, 1), (1, 0), (0, 0)], None, None, None, None]
    shape = spark.createDataFrame([([struct(box(0, 0, 4)), struct([(1, 1), (1, 1), (1, 1), (1, 1)])],), ([struct([(1, 1)] * 4), struct(box(0, 0, 1))],)], f"rings {RINGS}")
    assert [r[0] if r[0] is None else len(r[0]) for r in shape.select(rings.clean_polygon(F.col("rings"))).collect()] == [1, None]


def test_a_ring_over_the_date_line_becomes_two(spark):
    shapes = [[box(170, 0, 20), box(175, 5, 10)], [box(10, 0, 5)], [box(-185, 0, 2)], [[(178, 0), (184, 0), (184, 6), (182, 6), (182, 2), (178, 2), (178, 0)]]]
    df = spark.createDataFrame([(i, [struct(r) for r in s]) for i, s in enumerate(shapes)], f"i int, rings {RINGS}")
    parts = df.select("i", F.explode(rings.within_world(F.col("rings"))).alias("rings")).select("i", "rings", rings.area(F.col("rings")).alias("area")).collect()
    by = {i: [r for r in parts if r["i"] == i] for i in range(4)}
    assert [r["area"] for r in by[0]] == [150.0, 150.0] and [r["area"] for r in by[1]] == [25.0] and [r["area"] for r in by[2]] == [4.0] and sorted(r["area"] for r in by[3]) == [4.0, 16.0]
    assert all(-180 <= p["lon"] <= 180 for r in parts for ring in r["rings"] for p in ring)


def test_nearest_part_in_growing_circles(spark):
    """Points in, near and far from parts, with and without a limit and a group: as by comparing all."""
    rng = np.random.default_rng(3)
    parts = [(i % 3, f"p{i}", i, [struct(box(float(x), float(y), 1.0))]) for i, (x, y) in enumerate(zip(rng.uniform(-170, 169, 25), rng.uniform(-80, 79, 25), strict=True))]
    points = [(i, int(i % 4), float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-89, 89, 60), rng.uniform(-179, 179, 60), strict=True))]
    points += [(100, 0, parts[0][3][0][0][0] + 0.5, parts[0][3][0][0][1] + 0.5), (101, 0, None, 1.0), (102, None, 1.0, 1.0)]
    known = spark.createDataFrame(parts, f"state int, name string, position int, rings {RINGS}")
    asked = spark.createDataFrame(points, "id int, state int, lat double, lon double")

    def far(p, r):
        (y1, x1), (y2, x2) = r[3][0][0], r[3][0][2]
        return math.hypot(max(x1 - p[3], p[3] - x2, 0), max(y1 - p[2], p[2] - y2, 0))

    for group, reach in (("state", None), ("state", 30.0), (None, None)):
        got = {r["id"]: r["name"] for r in spatial.nearest_part(asked, known, "id", "name", "position", group, reach).collect()}
        for p in points:
            usual = [r for r in parts if p[2] is not None and (group is None or r[0] == p[1])]
            best = min(usual, key=lambda r: (far(p, r), r[2]), default=None)
            assert got[p[0]] == (best[1] if best and (reach is None or far(p, best) <= reach) else None), p
    assert spatial.nearest_part(asked, known.limit(0), "id", "name", "position").where("name IS NOT NULL").count() == 0


def test_overlaps_and_order_of_odd_polygons(spark):
    parts = spark.createDataFrame([("a", [struct(box(0, 0, 2))]), ("b", [struct(box(1, 1, 2))]), ("b", [struct(box(-3, -3, 4))]), ("c", [struct(box(2, 0, 1))]), ("d", [])], f"key string, rings {RINGS}")
    got = {(r["key"], r["key2"]): r["area"] for r in spatial.polygon_overlaps(parts, "key").collect()}
    assert got == {("a", "b"): pytest.approx(2.0)}
    ids = spatial.in_area_order(parts, "key", [], F.col("key") == "b").collect()
    assert sorted((r["id"], r["key"], r["area"]) for r in ids) == [(1, "b", 20.0), (2, "d", 0.0), (3, "c", 1.0), (4, "a", 4.0)]
    assert spatial.polygon_overlaps(parts.limit(0), "key").count() == spatial.in_area_order(parts.limit(0), "key", []).count() == 0


def test_areas_of_many_pairs_together(monkeypatch):
    """Each pair's area, with odd polygons among them, is the one that it has by itself; also in small parts."""
    rng = np.random.default_rng(5)
    shapes = [[], [np.array(box(0, 0, 2), float)], [np.array([(0, 0), (2, 1), (1, 3)], float)], [np.array([(0, 0), (math.nan, 1), (1, 1), (0, 0)])], [star(rng, 40, 0, 0, 3), star(rng, 9, 0, 0, 0.8)], [star(rng, 25, 1, 0.5, 3)], [np.array(box(50, 0, 1), float)]]
    pairs = [(a, b) for a in shapes for b in shapes]
    array = lambda side: pa.array([[[{"lat": y, "lon": x} for x, y in r] for r in p[side]] for p in pairs], rings.POLYGON)
    alone = [rings.shared_area(a, b) for a, b in pairs]
    assert rings.shared_areas(array(0), array(1)) == pytest.approx(alone, abs=1e-12) and sum(a > 0 for a in alone) > 8
    monkeypatch.setattr(rings, "AT_ONCE", 7)
    monkeypatch.setattr(rings, "EDGES_AT_ONCE", 11)
    assert rings.shared_areas(array(0), array(1)) == pytest.approx(alone, abs=1e-9)
    assert len(rings.shared_areas(array(0)[:0], array(1)[:0])) == 0


def test_overlaps_of_copies(spark, monkeypatch):
    """Copies within and between features, shapes in several lots, features with several parts on either side: as by comparing all parts."""
    monkeypatch.setattr(spatial, "MEMBERS", 3)
    rng = np.random.default_rng(9)
    made = [(f"k{int(rng.integers(25))}" if i % 2 else f"s{i}", float(rng.integers(3)), float(rng.integers(2))) for i in range(60)]
    expected, largest = {}, {}
    for i, (k, x, y) in enumerate(made):
        for k2, x2, y2 in made[:i]:
            area = max(0, 2 - abs(x - x2)) * max(0, 2 - abs(y - y2))
            if k != k2 and area:
                pair = (min(k, k2), max(k, k2))
                expected[pair], largest[pair] = expected.get(pair, 0) + area, max(largest.get(pair, 0), area)
    parts = spark.createDataFrame([(k, [struct(box(x, y, 2))], x, x + 2, y, y + 2) for k, x, y in made], f"key string, rings {RINGS}, minx double, maxx double, miny double, maxy double")
    found = [tuple(r) for r in spatial.polygon_overlaps(parts, "key").collect()]
    assert len(found) == len(expected) and {(a, b): area for a, b, area in found} == pytest.approx(expected)
    boxes = [tuple(r) for r in spatial.overlaps(parts, "key").collect()]
    assert len(boxes) == len(largest) and {(a, b): area for a, b, area in boxes} == largest


def test_pairs_are_dealt_and_stay(spark):
    """However few bytes pairs have, they are dealt before they are worked on, and only features of several parts meet for a total."""
    parts = spark.range(50).selectExpr("concat('k', id) AS key", "id * 0.5D AS minx", "id * 0.5D + 3 AS maxx", "0D AS miny", "1D AS maxy")
    text = spatial.overlaps(parts, "key")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    alone, together = text.split("HashAggregate", 1) if "HashAggregate" in text else text.split("SortAggregate", 1)
    assert "REPARTITION_BY_NUM" in alone and "NOT __several" in alone and "NOT __several" in together


def test_tasks_grow_with_the_pairs(spark, monkeypatch):
    """Copies make many pairs of few bytes: no task makes many more than its share, and none is lost, whatever the shuffle's partitions."""
    monkeypatch.setattr(spatial, "PAIRS", 50_000, raising=False)
    monkeypatch.setattr(spatial, "MEMBERS", 50)
    n = 1_000
    alike = spark.range(n).selectExpr("id AS key", "0D AS minx", "3D AS maxx", "0D AS miny", "1D AS maxy")
    beside = spark.range(n, 2 * n).selectExpr("id AS key", "1D AS minx", "4D AS maxx", "0D AS miny", "1D AS maxy")
    got = spatial.overlaps(alike.unionByName(beside), "key").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_if(F.col("area") == 3).alias("same"), F.count_if(F.col("key") < F.col("key2")).alias("ordered"), F.sum(F.hash("key", "key2").cast("long")).alias("digest")).collect()
    pairs = spark.range(2 * n).alias("a").join(spark.range(2 * n).alias("b"), F.expr("a.id < b.id")).select(F.sum(F.hash("a.id", "b.id").cast("long")))
    total = lambda c: sum(r[c] for r in got)
    assert total("n") == total("ordered") == n * (2 * n - 1) and total("same") == n * (n - 1) and total("digest") == pairs.first()[0]
    assert max(r["n"] for r in got) < 3 * 50_000
