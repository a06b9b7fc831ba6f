"""Coordinates and regions: ``customer`` and ``supplier`` stand for two tables of licensees.

A customer's latitude comes from the balance, the longitude from the key; regions are polygons given as values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import geo
from radiolake.operators import spatial
from radiolake.plans.tables import table

QUERIES, SQL = {}, {}
LAT, LON = "CAST(CAST(floor(c_acctbal) AS BIGINT) % 90 AS DOUBLE) + 0.25", "CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) + 0.25"
POINTS = f"pts AS (SELECT c_custkey, c_nationkey, {LAT} AS lat, {LON} AS lon FROM customer)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.expr(LAT).alias("lat"), F.expr(LON).alias("lon"))


QUERIES["maidenhead"] = lambda spark, sf_dir: points(spark, sf_dir).select("c_custkey", geo.maidenhead(F.col("lat"), F.col("lon")).alias("grid"))
_GRID = """substr('ABCDEFGHIJKLMNOPQR', CAST(floor(least(lon + 180, 359.999999) / 20) AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQR', CAST(floor(least(lat + 90, 179.999999) / 10) AS INT) + 1, 1)
  || CAST(floor(least(lon + 180, 359.999999) % 20 / 2) AS INT) || CAST(floor(least(lat + 90, 179.999999) % 10) AS INT)"""
SQL["maidenhead"] = f"WITH {POINTS} SELECT c_custkey, {_GRID} AS grid FROM pts"


def grid_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = geo.grid_center(F.col("grid"))
    return QUERIES["maidenhead"](spark, sf_dir).select("c_custkey", lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


QUERIES["grid_center"] = grid_center
SQL["grid_center"] = f"WITH {POINTS} SELECT c_custkey, floor(lat) + 0.5 AS lat, floor((lon + 180) / 2) * 2 - 180 + 1.0 AS lon FROM pts"

#: Where distances start if an event has no location.
HOME = (45.0, -123.0)
QUERIES["haversine_km"] = lambda spark, sf_dir: points(spark, sf_dir).select("c_custkey", geo.kilometres(*map(F.lit, HOME), F.col("lat"), F.col("lon")).alias("km"))
_A = "(pow(sin(radians(lat - 45.0) / 2), 2) + cos(radians(45.0)) * cos(radians(lat)) * pow(sin(radians(lon + 123.0) / 2), 2))"
SQL["haversine_km"] = f"WITH {POINTS} SELECT c_custkey, CAST(floor(6371.0 * 2 * atan2(sqrt({_A}), sqrt(1 - {_A}))) AS BIGINT) AS km FROM pts"
QUERIES["bearing"] = lambda spark, sf_dir: points(spark, sf_dir).select("c_custkey", geo.bearing(*map(F.lit, HOME), F.col("lat"), F.col("lon")).alias("degrees"))
SQL["bearing"] = f"""WITH {POINTS}, b AS (SELECT c_custkey, degrees(atan2(sin(radians(lon + 123.0)) * cos(radians(lat)),
  cos(radians(45.0)) * sin(radians(lat)) - sin(radians(45.0)) * cos(radians(lat)) * cos(radians(lon + 123.0)))) AS d FROM pts)
SELECT c_custkey, CAST(floor((d + 360) % 360 + 0.5) AS BIGINT) % 360 AS degrees FROM b"""

#: Regions with overlaps, an enclave, a hole and a part at the date line: feature, part and rings of (lat, lon).
REGIONS = [
    (1, 1, [[(0.0, -60.0), (0.0, 20.0), (50.0, 20.0), (50.0, -60.0), (0.0, -60.0)], [(10.0, -30.0), (10.0, -10.0), (20.0, -10.0), (20.0, -30.0), (10.0, -30.0)]]),
    (2, 2, [[(12.0, -28.0), (12.0, -12.0), (18.0, -12.0), (18.0, -28.0), (12.0, -28.0)]]),
    (3, 3, [[(30.0, 0.0), (80.0, 60.0), (30.0, 120.0), (30.0, 0.0)]]),
    (4, 4, [[(0.0, 150.0), (0.0, 180.0), (60.0, 180.0), (60.0, 150.0), (0.0, 150.0)]]),
    (4, 5, [[(0.0, -180.0), (0.0, -150.0), (60.0, -150.0), (60.0, -180.0), (0.0, -180.0)]]),
]


def region_parts(spark: SparkSession) -> DataFrame:
    """The parts with their boxes; a fixed table of a handful of rows."""
    rows = []
    for feature, part, rings in REGIONS:
        lats, lons = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        rows.append((feature, part, min(lons), max(lons), min(lats), max(lats), rings))
    return spark.createDataFrame(rows, "feature int, part int, minx double, maxx double, miny double, maxy double, rings array<array<struct<lat:double,lon:double>>>")


_EDGES = ", ".join(f"({f}, {p}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for f, p, rings in REGIONS for r in rings for a, b in zip(r, r[1:], strict=False))
_INSIDE = f"""e(feature, part, y1, x1, y2, x2) AS (VALUES {_EDGES}),
hits AS (SELECT c_custkey, feature, part FROM pts, e WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""
QUERIES["spatial_join"] = lambda spark, sf_dir: spatial.region_of(points(spark, sf_dir), region_parts(spark), [F.col("feature"), F.col("part")], "c_custkey", ["feature", "part"])
SQL["spatial_join"] = f"WITH {POINTS}, {_INSIDE} SELECT c_custkey, CAST(min(feature) AS INTEGER) AS feature, CAST(arg_min(part, (feature, part)) AS INTEGER) AS part FROM hits GROUP BY c_custkey"
QUERIES["enclave_tiebreak"] = lambda spark, sf_dir: spatial.region_of(
    points(spark, sf_dir), region_parts(spark).withColumn("area", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))), [F.col("area"), F.col("feature"), F.col("part")], "c_custkey", ["feature"]
)
SQL["enclave_tiebreak"] = f"""WITH {POINTS}, {_INSIDE}, a AS (SELECT part, (max(x1) - min(x1)) * (max(y1) - min(y1)) AS area FROM e GROUP BY part)
SELECT c_custkey, CAST(arg_min(feature, (area, feature, part)) AS INTEGER) AS feature FROM hits JOIN a USING (part) GROUP BY c_custkey"""


def spherical_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplied = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), (F.col("s_suppkey") % 80 + 0.5).cast("double").alias("lat"), (F.col("s_suppkey") * 11 % 180 + 0.5).cast("double").alias("lon"))
    found = spatial.anchors(points(spark, sf_dir).unionByName(supplied), "c_nationkey", "c_custkey")
    return found.select("c_nationkey", "members", "c_custkey")


QUERIES["spherical_anchor"] = spherical_anchor
SQL["spherical_anchor"] = f"""WITH {POINTS}, m AS (SELECT c_custkey, c_nationkey, lat, lon FROM pts UNION ALL
  SELECT -s_suppkey, s_nationkey, CAST(s_suppkey % 80 + 0.5 AS DOUBLE), CAST(s_suppkey * 11 % 180 + 0.5 AS DOUBLE) FROM supplier),
u AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM m),
c AS (SELECT c_nationkey, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS members FROM u GROUP BY c_nationkey)
SELECT c_nationkey, members, arg_min(c_custkey, (round((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), 9), c_custkey)) AS c_custkey FROM u JOIN c USING (c_nationkey) GROUP BY c_nationkey, members"""


def nearest_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("area"), F.floor("p_retailprice").cast("long").alias("zip"))
    known = part.where("p_partkey % 5 = 0").withColumnRenamed("p_partkey", "known_key")
    return spatial.nearest_key(part.where("p_partkey % 5 <> 0"), known, "area", "zip", "p_partkey", "known_key").select("p_partkey", "known_key")


QUERIES["nearest_zip"] = nearest_zip
SQL["nearest_zip"] = """WITH p AS (SELECT p_partkey, p_size AS area, CAST(floor(p_retailprice) AS BIGINT) AS zip FROM part)
SELECT a.p_partkey, arg_min(b.p_partkey, (abs(a.zip - b.zip), b.p_partkey)) AS known_key FROM p a JOIN p b ON a.area = b.area AND a.p_partkey % 5 <> 0 AND b.p_partkey % 5 = 0 GROUP BY a.p_partkey"""
