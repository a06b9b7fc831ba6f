"""Queries on polygons: what they share, their order by area, projection and the date line; shapes made from the given tables."""

from __future__ import annotations

import struct

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import rings
from radiolake.operators import spatial
from radiolake.plans.tables import table
from radiolake.shared import shared_dir
from radiolake.sources import shapefile

QUERIES, SQL = {}, {}


def ring(*points: tuple) -> Column:
    """A closed ring through points (x, y) that are expressions."""
    p = [F.struct(F.expr(str(y)).cast("double").alias("lat"), F.expr(str(x)).cast("double").alias("lon")) for x, y in points]
    return F.array(*p, p[0])


def square(x: str, y: str, side: str) -> Column:
    return ring((x, y), (f"{x} + {side}", y), (f"{x} + {side}", f"{y} + {side}"), (x, f"{y} + {side}"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (squares with a hole) for the regions, squares for the suppliers, triangles for the nations, which have a second part far away."""
    frames = table(spark, sf_dir, "region").select(F.concat(F.lit("F"), "r_regionkey").alias("key"), F.array(square("r_regionkey * 4", "r_regionkey", "10"), square("r_regionkey * 4 + 2", "r_regionkey + 2", "6")).alias("rings"))
    squares = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("key"), F.array(square("(s_suppkey * 7 % 1009) * 0.25D", "(s_suppkey * 13 % 61) * 0.5D", "1.5D")).alias("rings"))
    nation = table(spark, sf_dir, "nation").withColumn("y", F.lit(50))
    triangles = nation.select(F.concat(F.lit("T"), "n_nationkey").alias("key"), F.array(ring(("n_nationkey", "y"), ("n_nationkey + 2", "y"), ("n_nationkey", "y + 2"))).alias("rings"))
    far = nation.select(F.concat(F.lit("T"), "n_nationkey").alias("key"), F.array(ring(("n_nationkey", "-60"), ("n_nationkey + 2", "-60"), ("n_nationkey", "-58"))).alias("rings"))
    return frames.unionByName(squares).unionByName(triangles).unionByName(far)


QUERIES["polygon_overlaps"] = lambda spark, sf_dir: spatial.polygon_overlaps(polygons(spark, sf_dir), "key").withColumn("area", F.round("area", 9))
#: Squares and frames as a square less a hole; a triangle meets only its neighbour, in half a square degree, twice.
SQL["polygon_overlaps"] = """WITH p AS (SELECT 'F' || r_regionkey AS key, r_regionkey * 4.0::DOUBLE AS x, r_regionkey * 1.0::DOUBLE AS y, 10.0::DOUBLE AS side, 2.0::DOUBLE AS hole FROM region
  UNION ALL SELECT 'S' || s_suppkey, (s_suppkey * 7 % 1009) * 0.25::DOUBLE, (s_suppkey * 13 % 61) * 0.5::DOUBLE, 1.5::DOUBLE, 0.75::DOUBLE FROM supplier),
r AS (SELECT key, 1 AS sign, x, y, side FROM p UNION ALL SELECT key, -1, x + hole, y + hole, side - 2 * hole FROM p WHERE side > 2 * hole),
o AS (SELECT a.key, b.key AS key2, sum(a.sign * b.sign * greatest(0, least(a.x + a.side, b.x + b.side) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.side, b.y + b.side) - greatest(a.y, b.y))) AS area FROM r a JOIN r b ON a.key < b.key
  AND a.x < b.x + b.side AND b.x < a.x + a.side GROUP BY ALL)
SELECT key, key2, round(area, 9) AS area FROM o WHERE area > 1e-7
UNION ALL SELECT least(a, b), greatest(a, b), 1.0 FROM (SELECT 'T' || x.n_nationkey AS a, 'T' || y.n_nationkey AS b FROM nation x JOIN nation y ON y.n_nationkey = x.n_nationkey + 1)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier a square, every third one with a hole, every fifth one with a triangle beside it."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") % 2 == 0, "US").otherwise("CA").alias("country"), (1 + F.col("s_suppkey") % 17).alias("side"))
    hole = square("0.25D", "0.25D", "side / 2")
    outline = square("0", "0", "side")
    main = rows.select("s_suppkey", "s_name", "country", F.when(F.col("s_suppkey") % 3 == 0, F.array(outline, hole)).otherwise(F.array(outline)).alias("rings"))
    beside = rows.where("s_suppkey % 5 = 0").select("s_suppkey", "s_name", "country", F.array(ring(("100", "0"), ("100 + side", "0"), ("100", "1"))).alias("rings"))
    return main.unionByName(beside)


_AREAS = """a AS (SELECT s_suppkey, s_name, s_nationkey % 2 = 0 AS us, (1 + s_suppkey % 17) AS side, side * side - CASE WHEN s_suppkey % 3 = 0 THEN side * side / 4.0 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN side / 2.0 ELSE 0 END AS area FROM supplier)"""
QUERIES["entity_order"] = lambda spark, sf_dir: spatial.in_area_order(entities(spark, sf_dir), "s_suppkey", ["s_name"])
SQL["entity_order"] = f"WITH {_AREAS} SELECT s_suppkey, s_name, area::DOUBLE AS area, row_number() OVER (ORDER BY area, s_name) AS id FROM a"
QUERIES["county_order"] = lambda spark, sf_dir: spatial.in_area_order(entities(spark, sf_dir), "s_suppkey", ["s_name"], F.col("country") == "US").select("s_suppkey", "id")
SQL["county_order"] = f"WITH {_AREAS} SELECT s_suppkey, row_number() OVER (ORDER BY us DESC, area, s_name) AS id FROM a"


def enclave_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares in squares: each customer's point takes the smallest that holds it, by the ids of the order by area."""
    parts = table(spark, sf_dir, "nation").select("n_name", F.array(square("0", "0", "(1 + n_nationkey * 2)")).alias("rings"))
    ids = spatial.in_area_order(parts, "n_name", [])
    boxed = parts.join(ids, "n_name").select("n_name", "id", "rings", *[F.expr(e).cast("double").alias(c) for c, e in {"minx": "rings[0][0].lon", "maxx": "rings[0][1].lon", "miny": "rings[0][0].lat", "maxy": "rings[0][2].lat"}.items()])
    points = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 601 * 0.1 + 0.05).alias("lat"), (F.col("c_custkey") % 53 + 0.5).alias("lon"))
    return spatial.region_of(points, boxed, [F.col("id")], "c_custkey", ["n_name", "id"], part="id")


QUERIES["enclave_lookup"] = enclave_lookup
SQL["enclave_lookup"] = """WITH n AS (SELECT n_name, 1 + n_nationkey * 2 AS side, row_number() OVER (ORDER BY n_nationkey) AS id FROM nation), c AS (SELECT c_custkey, greatest(c_custkey % 601 * 0.1 + 0.05, c_custkey % 53 + 0.5) AS far FROM customer)
SELECT c_custkey, arg_min(n_name, side) AS n_name, min(id) AS id FROM c JOIN n ON far < side GROUP BY 1"""

_LAT, _LON = "(45 + o_custkey % 300 * 0.1D)", "(-130 + o_orderkey % 700 * 0.1D)"


def reprojected_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles projected to metres and back: every second one with a repeated point and closed, every fifth one with a hole that collapses, every seventh one too small."""
    cone = rings.Conic(**rings.CENSUS)
    metres = lambda p: [F.round(v, 3).alias(c) for v, c in zip(cone.forward(p["lat"], p["lon"]), ("x", "y"), strict=True)]
    project = lambda r: F.transform(r, lambda p: F.struct(*metres(p)))
    size = "IF(o_orderkey % 7 = 0, 1e-8D, 1.5D)"
    corners = ring((_LON, _LAT), (f"{_LON} + {size}", _LAT), (_LON, f"{_LAT} + {size}"))
    outline = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.slice(corners, 1, 2), F.slice(corners, 2, 3))).otherwise(F.slice(corners, 1, 3))
    lost = ring((_LON, _LAT), (f"{_LON} + 1e-8D", _LAT), (_LON, f"{_LAT} + 1e-8D"))
    shape = F.when(F.col("o_orderkey") % 5 == 0, F.array(outline, lost)).otherwise(F.array(outline))
    read = F.transform(F.transform(shape, project), lambda r: rings.projected(r, cone))
    out = table(spark, sf_dir, "orders").select("o_orderkey", rings.clean_polygon(read).alias("rings"))
    point = lambda i: [F.expr(f"rings[0][{i}].{c}").alias(f"{c}{i}") for c in ("lat", "lon")]
    return out.select("o_orderkey", F.size("rings").alias("n_rings"), F.size(F.expr("rings[0]")).alias("n_points"), *point(0), *point(1), *point(2), *point(3))


QUERIES["reprojected_rings"] = reprojected_rings
_CORNERS = [("", ""), (" + 1.5", ""), ("", " + 1.5"), ("", "")]
_POINTS = ", ".join(f"CASE WHEN ok THEN round({_LAT.replace('D)', ')')}{dy}, 6)::DOUBLE END AS lat{i}, CASE WHEN ok THEN round({_LON.replace('D)', ')')}{dx}, 6)::DOUBLE END AS lon{i}" for i, (dx, dy) in enumerate(_CORNERS))
SQL["reprojected_rings"] = f"WITH o AS (SELECT *, o_orderkey % 7 <> 0 AS ok FROM orders) SELECT o_orderkey, CASE WHEN ok THEN 1 END AS n_rings, CASE WHEN ok THEN 4 END AS n_points, {_POINTS} FROM o"


def date_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around the earth with a hole each, in degrees from 160 to 200 and from -200 to -160: one part or two."""
    x = "IF(c_custkey % 2 = 0, 160 + c_custkey % 37, -200 + c_custkey % 37 - 3)"
    shape = F.array(square(x, "c_custkey % 60", "4"), square(f"{x} + 1", "c_custkey % 60 + 1", "2"))
    parts = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(rings.within_world(shape)).alias("part", "rings"))
    ends = lambda f: f(F.transform(F.flatten("rings"), lambda p: p["lon"]))
    return parts.select("c_custkey", ends(F.array_min).alias("minx"), ends(F.array_max).alias("maxx"), F.round(rings.area(F.col("rings")), 9).alias("area"))


QUERIES["date_line"] = date_line
SQL["date_line"] = """WITH b AS (SELECT c_custkey, (CASE WHEN c_custkey % 2 = 0 THEN 160 + c_custkey % 37 ELSE -203 + c_custkey % 37 END)::DOUBLE AS x FROM customer),
t AS (SELECT c_custkey, x, greatest(x + s, -180) AS minx, least(x + 4 + s, 180) AS maxx, greatest(0, least(x + 3 + s, 180) - greatest(x + 1 + s, -180)) AS hole FROM b, (VALUES (0), (-360), (360)) v(s))
SELECT c_custkey, minx, maxx, (maxx - minx) * 4 - hole * 2 AS area FROM t WHERE maxx > minx"""


# --- shapefiles -----------------------------------------------------------------------------------------------------


def write_layer(path: str, rows: list[tuple[dict[str, str], list[list[tuple[float, float]]] | None]], encoding: str = "latin-1") -> None:
    """A layer's three files from attributes and rings of (x, y), as other programs write them; for small layers, such as fixtures."""
    widths = {n: max(len(r[0][n].encode(encoding)) for r in rows) for n in rows[0][0]}
    shp, shx = b"", b""
    for i, (_, shape) in enumerate(rows):
        if shape is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for r in shape for p in r]
            box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))
            first = [sum(len(r) for r in shape[:k]) for k in range(len(shape))]
            content = struct.pack("<i4d2i", 5, *box, len(shape), len(points)) + struct.pack(f"<{len(first)}i", *first) + b"".join(struct.pack("<2d", *p) for p in points)
        shx += struct.pack(">2i", (100 + len(shp)) // 2, len(content) // 2)
        shp += struct.pack(">2i", i + 1, len(content) // 2) + content
    head = lambda body: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body
    described = b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([w, 0]) + bytes(14) for n, w in widths.items())
    record = b"".join(b" " + b"".join(r[0][n].encode(encoding).ljust(w) for n, w in widths.items()) for r in rows)
    dbf = struct.pack("<4B IHH", 3, 124, 1, 1, len(rows), 33 + len(described), 1 + sum(widths.values())) + bytes(20) + described + b"\r" + record + b"\x1a"
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rpartition("/")[0])
    for kind, data in (("shp", head(shp)), ("shx", head(shx)), ("dbf", dbf)):
        with system.open_output_stream(f"{place}.{kind}") as out:
            out.write(data)


def file_shapefile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer of the 25 nations, four records a task: squares with a hole, every third with a second part, one without a shape."""
    square_of = lambda x, y, s: [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
    rows = []
    for k, name in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect():
        shape = [square_of(k, 0.0, 3.0 + k), square_of(k + 1.0, 1.0, 1.0)[::-1]] + ([square_of(k + 100.0, 10.0, 2.0)] if k % 3 == 0 else [])
        rows.append(({"KEY": str(k), "NAME": name + "é", "EMPTY": ""}, None if k == 7 else shape))
    path = f"{shared_dir(spark)}/layer"
    write_layer(path, rows)
    read = shapefile.layer(spark, f"{path}.shp", ["NAME", "KEY", "EMPTY"], "latin-1", 4)
    areas = F.aggregate(F.transform("parts", rings.area), F.lit(0.0), lambda a, b: a + b)
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("KEY"), "n_regionkey")
    return read.join(known, "KEY").select(F.col("KEY").cast("int").alias("key"), "n_regionkey", F.col("NAME").alias("name"), F.col("EMPTY").alias("blank"), "record", F.size("parts").alias("n_parts"), F.size(F.expr("parts[0]")).alias("n_rings"), areas.alias("area"))


QUERIES["file_shapefile"] = file_shapefile
SQL["file_shapefile"] = """SELECT CAST(n_nationkey AS INTEGER) AS key, n_regionkey, n_name || 'é' AS name, CAST(NULL AS VARCHAR) AS blank, CAST(n_nationkey AS BIGINT) AS record, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS n_parts, 2 AS n_rings,
  (3 + n_nationkey) ** 2 - 1.0 + CASE WHEN n_nationkey % 3 = 0 THEN 4 ELSE 0 END AS area FROM nation WHERE n_nationkey <> 7"""
