"""Operators' entries over looked-up records: positions, layers, parks and anchors made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import geo, scalars
from radiolake.operators import location
from radiolake.operators.location import Layer
from radiolake.plans.places import _EDGES, _GRID, HOME, POINTS, points, region_parts
from radiolake.plans.tables import table

QUERIES, SQL = {}, {}

#: A customer's record, and what an operator typed over it; some records have no position.
_RECORD = {
    "latitude": "CASE WHEN c_custkey % 41 <> 0 THEN lat END", "longitude": "CASE WHEN c_custkey % 41 <> 0 THEN lon END",
    "state": "CASE c_nationkey % 5 WHEN 0 THEN 'OR' WHEN 1 THEN 'WA' WHEN 2 THEN 'CA' WHEN 3 THEN 'TX' ELSE 'HI' END", "section": "concat('S', c_nationkey)",
    "county": "'old'", "country": "'Old'", "dxcc": "1", "cq_zone": "CASE WHEN c_custkey % 3 <> 0 THEN 7 END", "itu_zone": "CASE WHEN c_custkey % 7 <> 0 THEN 9 END",
    "typed_latitude": "CASE c_custkey % 11 WHEN 0 THEN '10.25' WHEN 1 THEN concat(lat, '') WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 4 THEN '95' END",
    "typed_longitude": "CASE c_custkey % 11 WHEN 0 THEN '-20.25' WHEN 1 THEN concat(lon, '') WHEN 3 THEN '5' WHEN 4 THEN '5' WHEN 5 THEN '5' END",
    "typed_park": "CASE c_custkey % 7 WHEN 0 THEN concat(' us-', c_custkey % 300, ', US-1') WHEN 1 THEN ',' WHEN 2 THEN concat('(US-', c_custkey % 50, ')') END",
    "typed_section": "CASE c_custkey % 5 WHEN 0 THEN concat('s', c_custkey % 25, ' ') WHEN 1 THEN 'ZZZ' END",
    "typed_state": "CASE c_custkey % 4 WHEN 0 THEN ' oregon' WHEN 1 THEN 'TX' WHEN 2 THEN 'nowhere' END",
    "typed_grid": "CASE c_custkey % 3 WHEN 0 THEN 'cn87uo' WHEN 1 THEN 'ZZ99' END",
}
_PARK = {
    "reference": "concat('US-', p_partkey)", "name": "CASE WHEN p_partkey % 7 <> 0 THEN concat('Park ', p_partkey) ELSE '' END",
    "latitude": "CASE WHEN p_partkey % 9 = 0 THEN CAST(0 AS DOUBLE) WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey % 80 AS DOUBLE) + CAST(0.5 AS DOUBLE) END",
    "longitude": "CASE WHEN p_partkey % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(p_partkey * 13 % 360 - 180 AS DOUBLE) + CAST(0.5 AS DOUBLE) END",
}
#: Where the members of a section are; of the last nations there are none.
_SECTION = {"code": "concat('S', n_nationkey)", "lat": "CAST(n_nationkey * 3 - 20 AS DOUBLE) + CAST(0.25 AS DOUBLE)", "lon": "CAST(n_nationkey * 13 - 160 AS DOUBLE) + CAST(0.25 AS DOUBLE)"}
_STATE = {"code": "CASE n_nationkey WHEN 0 THEN 'OR' WHEN 1 THEN 'WA' WHEN 2 THEN 'HI' ELSE 'TX' END", "lat": "CAST(n_nationkey * 7 + 5 AS DOUBLE) + CAST(0.25 AS DOUBLE)", "lon": "CAST(n_nationkey * 30 - 100 AS DOUBLE) + CAST(0.25 AS DOUBLE)"}
_PLACE = {"state": _RECORD["state"].replace("c_nationkey", "n_nationkey"), "section": "CASE WHEN n_nationkey % 5 < 2 THEN concat('S', n_nationkey % 5) ELSE concat('S', n_nationkey) END"}


def _columns(df: DataFrame, columns: dict[str, str], *first: str) -> DataFrame:
    return df.select(*first, *[F.expr(e).alias(n) for n, e in columns.items()])


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def layers(spark: SparkSession) -> dict[str, Layer]:
    """Four layers over the fixed regions, each with its own attributes and order."""
    parts = region_parts(spark).withColumns({
        "area": (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")), "cq_zone": F.col("feature") * 10, "itu_zone": F.col("part"), "country": F.concat(F.lit("Land "), F.col("feature").cast("string")),
        "dxcc": F.col("feature") + 100, "county": F.concat(F.lit("C"), F.col("part").cast("string")), "state": F.element_at(F.array(*map(F.lit, ("WA", "OR", "TX", "HI", "CA"))), F.col("part")), "section": F.concat(F.lit("T"), F.col("feature").cast("string")),
    })
    orders = {"cq": ["feature", "part"], "itu": ["part"], "dxcc": ["area", "feature", "part"], "county": ["down"]}
    parts = parts.withColumn("down", -F.col("part"))
    return {name: Layer(parts, [F.col(c) for c in orders[name]], location.FROM_LAYER[name]) for name in orders}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _columns(points(spark, sf_dir), _RECORD, "c_custkey")
    return rows.withColumn("gridsquare", geo.maidenhead(F.col("latitude"), F.col("longitude")))


def lookup_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return location.postprocess(
        records(spark, sf_dir), "c_custkey", layers(spark), _columns(table(spark, sf_dir, "part"), _PARK), _columns(nation.where("n_nationkey < 20"), _SECTION), _columns(nation.where("n_nationkey < 4"), _STATE),
        location.section_of_state(_columns(nation, _PLACE)), HOME,
    )


QUERIES["lookup_postprocess"] = lookup_postprocess
#: The regions that hold the points ``pos`` (key, y, x), and each layer's choice.
_LAYERS = f"""e(feature, part, y1, x1, y2, x2) AS (VALUES {_EDGES}), area AS (SELECT part, (max(x1) - min(x1)) * (max(y1) - min(y1)) AS area FROM e GROUP BY part),
held AS (SELECT key, feature, part, area FROM pos JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 JOIN area USING (part) WHERE y BETWEEN -90 AND 90 AND x BETWEEN -180 AND 180 GROUP BY ALL HAVING count(*) % 2 = 1),
found AS (SELECT key, CAST(arg_min(feature, (feature, part)) * 10 AS INTEGER) AS cq, CAST(min(part) AS INTEGER) AS itu, arg_min(feature, (area, feature, part)) AS land, max(part) AS county, arg_max(feature, part) AS tract FROM held GROUP BY key),
new AS (SELECT pos.key, y, x, CASE WHEN y BETWEEN -90 AND 90 AND x BETWEEN -180 AND 180 THEN {_GRID.replace("lon", "x").replace("lat", "y")} END AS n_grid, cq AS n_cq, itu AS n_itu, 'Land ' || land AS n_country, CAST(land + 100 AS INTEGER) AS n_dxcc,
  'C' || county AS n_county, CASE county WHEN 1 THEN 'WA' WHEN 2 THEN 'OR' WHEN 3 THEN 'TX' WHEN 4 THEN 'HI' WHEN 5 THEN 'CA' END AS n_state, 'T' || tract AS n_section FROM pos LEFT JOIN found USING (key))"""
_FAR = "(pow(sin(radians(y - 45.0) / 2), 2) + cos(radians(45.0)) * cos(radians(y)) * pow(sin(radians(x + 123.0) / 2), 2))"
SQL["lookup_postprocess"] = f"""WITH {POINTS}, r0 AS (SELECT c_custkey, {_sql(_RECORD)} FROM pts), r1 AS (SELECT *, CASE WHEN latitude IS NOT NULL THEN {_GRID.replace("lon", "longitude").replace("lat", "latitude")} END AS gridsquare FROM r0),
k AS (SELECT {_sql(_PARK)} FROM part), sec AS (SELECT {_sql(_SECTION)} FROM nation WHERE n_nationkey < 20), st AS (SELECT {_sql(_STATE)} FROM nation WHERE n_nationkey < 4),
one AS (SELECT state, min(section) AS section FROM (SELECT {_sql(_PLACE)} FROM nation) GROUP BY state HAVING count(DISTINCT section) = 1),
t AS (SELECT r1.*, k.name AS park_name, k.latitude AS p_lat, k.longitude AS p_lon, upper(trim(typed_section)) AS t_section, CASE WHEN typed_state = ' oregon' THEN 'OR' WHEN typed_state = 'TX' THEN 'TX' END AS t_state,
  CASE WHEN typed_grid = 'cn87uo' THEN 'CN87' END AS t_grid, TRY_CAST(nullif(typed_latitude, '') AS DOUBLE) AS t_lat, TRY_CAST(typed_longitude AS DOUBLE) AS t_lon
  FROM r1 LEFT JOIN k ON k.reference = CASE c_custkey % 7 WHEN 0 THEN 'US-' || (c_custkey % 300) WHEN 2 THEN 'US-' || (c_custkey % 50) END AND k.latitude IS NOT NULL AND NOT (k.latitude = 0 AND k.longitude = 0)),
b AS (SELECT t.*, sec.lat AS s_lat, sec.lon AS s_lon, st.lat AS u_lat, st.lon AS u_lon, one.section AS one_section, CASE WHEN t_lat IS NOT NULL AND t_lon IS NOT NULL AND (t_lat IS DISTINCT FROM latitude OR t_lon IS DISTINCT FROM longitude) THEN 'coordinates'
  WHEN p_lat IS NOT NULL THEN 'park' WHEN t_section IS NOT NULL AND t_section <> t.section AND sec.lat IS NOT NULL THEN 'section' WHEN t_state IS NOT NULL AND t_state <> t.state AND st.lat IS NOT NULL THEN 'state'
  WHEN t_grid IS NOT NULL AND t_grid IS DISTINCT FROM gridsquare THEN 'grid' END AS kind FROM t LEFT JOIN sec ON sec.code = t_section LEFT JOIN st ON st.code = t_state LEFT JOIN one ON one.state = t_state),
pos AS (SELECT c_custkey AS key, CASE kind WHEN 'coordinates' THEN t_lat WHEN 'park' THEN p_lat WHEN 'section' THEN s_lat WHEN 'state' THEN u_lat WHEN 'grid' THEN 47.5 ELSE latitude END AS y,
  CASE kind WHEN 'coordinates' THEN t_lon WHEN 'park' THEN p_lon WHEN 'section' THEN s_lon WHEN 'state' THEN u_lon WHEN 'grid' THEN -123.0 ELSE longitude END AS x FROM b), {_LAYERS}
SELECT c_custkey, y AS latitude, x AS longitude, CASE WHEN kind IN ('coordinates', 'park') THEN n_grid WHEN kind = 'grid' THEN t_grid WHEN kind IS NULL THEN gridsquare END AS gridsquare,
  CASE WHEN kind IS NULL THEN coalesce(cq_zone, n_cq) ELSE n_cq END AS cq_zone, CASE WHEN kind IS NULL THEN coalesce(itu_zone, n_itu) ELSE n_itu END AS itu_zone, CASE WHEN kind IS NULL THEN country ELSE n_country END AS country,
  CASE WHEN kind IS NULL THEN dxcc ELSE n_dxcc END AS dxcc, CASE WHEN kind IN ('coordinates', 'park') THEN n_county WHEN kind IS NULL THEN county END AS county,
  CASE WHEN kind IN ('coordinates', 'park', 'section') THEN n_state WHEN kind = 'state' THEN t_state WHEN kind IS NULL THEN state END AS state,
  CASE WHEN kind IN ('coordinates', 'park') THEN n_section WHEN kind = 'section' THEN t_section WHEN kind = 'state' THEN one_section WHEN kind IS NULL THEN section END AS section,
  CASE WHEN y BETWEEN -90 AND 90 AND x BETWEEN -180 AND 180 THEN CAST(floor(6371.0 * 2 * atan2(sqrt({_FAR}), sqrt(1 - {_FAR}))) AS BIGINT) END AS distance,
  CASE WHEN kind = 'park' THEN nullif(park_name, '') END AS pota_park, kind AS override FROM b JOIN new ON new.key = c_custkey"""

QUERIES["recalculate"] = lambda spark, sf_dir: location.recalculated(records(spark, sf_dir), layers(spark), "c_custkey", ["state", "dxcc", "gridsquare"]).select("c_custkey", "latitude", "state", "dxcc", "gridsquare", "county")
SQL["recalculate"] = f"""WITH {POINTS}, r AS (SELECT c_custkey, {_sql(_RECORD)} FROM pts), pos AS (SELECT c_custkey AS key, latitude AS y, longitude AS x FROM r), {_LAYERS}
SELECT c_custkey, latitude, CASE WHEN latitude IS NULL THEN state ELSE n_state END AS state, CASE WHEN latitude IS NULL THEN dxcc ELSE n_dxcc END AS dxcc, n_grid AS gridsquare, county FROM r JOIN new ON new.key = c_custkey"""

QUERIES["park_join"] = lambda spark, sf_dir: location.parks_of(records(spark, sf_dir).select("c_custkey", "typed_park"), _columns(table(spark, sf_dir, "part"), _PARK), "typed_park").drop("typed_park")
SQL["park_join"] = f"""WITH k AS (SELECT {_sql(_PARK)} FROM part) SELECT c_custkey, name AS park_name, latitude AS park_lat, longitude AS park_lon FROM customer
LEFT JOIN k ON reference = CASE c_custkey % 7 WHEN 0 THEN 'US-' || (c_custkey % 300) WHEN 2 THEN 'US-' || (c_custkey % 50) END AND latitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)"""

_ZONED = "CASE c_custkey % 10 WHEN 0 THEN ' or' WHEN 1 THEN 'MD' WHEN 2 THEN 'CA' WHEN 3 THEN 'AE' WHEN 4 THEN 'GU' WHEN 5 THEN 'nt' WHEN 6 THEN 'ON' WHEN 7 THEN 'XX' WHEN 8 THEN 'NY' END"


def section_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of customers by state, and by county (their nation) where several share a state."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.expr(_ZONED).alias("state"), F.col("n_name").alias("county"))
    shared = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.explode(F.array(F.lit("CA"), F.lit("ON"))).alias("state"), F.col("n_name").alias("county"), F.concat("state", F.col("n_regionkey").cast("string")).alias("section"))
    return location.with_section(rows, shared).select("c_custkey", "section")


QUERIES["section_for"] = section_for
SQL["section_for"] = """SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN 'OR' WHEN 1 THEN 'MDC' WHEN 2 THEN CASE WHEN n_regionkey < 3 THEN 'CA' || n_regionkey END WHEN 4 THEN 'PAC' WHEN 5 THEN 'TER'
  WHEN 6 THEN CASE WHEN n_regionkey < 3 THEN 'ON' || n_regionkey END END AS section FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def prefix_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix list's answers as records: coordinates out of their units, zones in their ranges."""
    answers = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("K"), F.col("n_nationkey").cast("string")).alias("call"), F.col("n_name").alias("territory"), F.lit("NA").alias("continent"), (F.col("n_nationkey") * 4).cast("string").alias("itu"), (F.col("n_nationkey") * 2).cast("string").alias("cq"),
        F.lit("291").alias("dxcc"), (F.col("n_nationkey") * 360).cast("string").alias("lat"), (F.col("n_nationkey") * -900).cast("string").alias("lon"),
    )
    columns, bad = location.parsed_record(answers)
    return answers.select(*columns, bad.alias("dirty")).select("callsign", "country", "continent", "itu_zone", "cq_zone", "dxcc", "latitude", "longitude", "name", "dirty")


QUERIES["prefix_record"] = prefix_record
SQL["prefix_record"] = """SELECT 'K' || n_nationkey AS callsign, n_name AS country, 'NA' AS continent, CAST(CASE WHEN n_nationkey BETWEEN 1 AND 22 THEN n_nationkey * 4 END AS INTEGER) AS itu_zone, CAST(CASE WHEN n_nationkey BETWEEN 1 AND 20 THEN n_nationkey * 2 END AS INTEGER) AS cq_zone,
  291 AS dxcc, n_nationkey * 2.0::DOUBLE AS latitude, n_nationkey * -900 / 180.0::DOUBLE AS longitude, CAST(NULL AS VARCHAR) AS name,
  concat_ws(',', CASE WHEN n_nationkey = 0 OR n_nationkey > 22 THEN 'itu_zone' END, CASE WHEN n_nationkey = 0 OR n_nationkey > 20 THEN 'cq_zone' END) AS dirty FROM nation"""


def licensee_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A licensee's row as a record: names, kind, class, address lines, dates, and what can't be read."""
    raw = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("CASE c_custkey % 4 WHEN 0 THEN 'Amateur Club' WHEN 1 THEN 'Consortium' ELSE 'Individual' END").alias("kind"), F.col("c_mktsegment").alias("last"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN ' Q' ELSE ' ' END").alias("middle"),
        F.expr("CASE c_custkey % 5 WHEN 0 THEN 'e' WHEN 1 THEN 'G ' WHEN 2 THEN 'X' END").alias("class"), F.expr("CASE WHEN c_custkey % 6 < 2 THEN ' ' ELSE concat(c_custkey, ' MAIN') END").alias("street"), F.expr("CASE WHEN c_custkey % 6 = 0 THEN '77' END").alias("box"),
        F.expr("CASE WHEN c_custkey % 7 <> 0 THEN 'TOWN' END").alias("city"), F.expr("CASE WHEN c_custkey % 8 = 0 THEN 'new  york' WHEN c_custkey % 8 = 1 THEN 'zz' ELSE 'or' END").alias("region"), F.expr("CASE WHEN c_custkey % 9 <> 0 THEN '97201' END").alias("zip"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN '2/3/2024' WHEN 1 THEN '2024-02-30' WHEN 2 THEN '2024-12-31' END").alias("granted"), F.expr("CASE WHEN c_custkey % 10 = 0 THEN 'x,y' ELSE concat(c_custkey % 80, '.5,-', c_custkey % 170) END").alias("coordinates"),
    )
    line1, line2 = scalars.address_lines(F.col("street"), F.col("box"), F.col("city"), F.upper("region"), F.col("zip"))
    pair = F.split("coordinates", ",", 2)
    name = scalars.licensee_name(F.col("kind"), F.lit("PAT"), F.col("middle"), F.col("last"), F.lit(None).cast("string"), F.lit("THE CLUB"))
    columns, bad = scalars.record({
        "callsign": F.concat(F.lit("K"), F.col("c_custkey").cast("string")), "name": name, "license_type": F.coalesce(scalars.lookup(scalars.KINDS, F.col("kind")), F.col("kind")), "license_class": scalars.lookup(scalars.CLASSES, F.upper(F.trim("class"))),
        "address_line1": line1, "address_line2": line2, "state": F.col("region"), "latitude": pair[0], "longitude": pair[1], "grant_date": F.col("granted"), "gridsquare": F.lit("cn87uo"), "dxcc": F.lit(291),
    })
    return raw.select(*columns, bad.alias("dirty"))


QUERIES["licensee_record"] = licensee_record
_NONE = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in (*((f, "VARCHAR") for f in ("source", "fetched_at", "previous_callsign", "trustee_callsign", "trustee_name", "address_attn", "county", "country", "continent", "frn", "previous_license_class", "section", "expiry_date")), ("itu_zone", "INTEGER"), ("cq_zone", "INTEGER")))
SQL["licensee_record"] = f"""SELECT 'K' || c_custkey AS callsign, CASE WHEN c_custkey % 4 > 1 THEN 'PAT ' || CASE WHEN c_custkey % 3 = 0 THEN 'Q ' ELSE '' END || c_mktsegment ELSE 'THE CLUB' END AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'club' WHEN 1 THEN 'consortium' ELSE 'person' END AS license_type, CASE c_custkey % 5 WHEN 0 THEN 'extra' WHEN 1 THEN 'general' END AS license_class,
  CASE WHEN c_custkey % 6 >= 2 THEN c_custkey || ' MAIN' WHEN c_custkey % 6 = 0 THEN 'PO BOX 77' END AS address_line1,
  CASE WHEN c_custkey % 7 <> 0 THEN 'TOWN, ' || CASE c_custkey % 8 WHEN 0 THEN 'NEW  YORK' WHEN 1 THEN 'ZZ' ELSE 'OR' END || CASE WHEN c_custkey % 9 <> 0 THEN ' 97201' ELSE '' END END AS address_line2,
  CASE c_custkey % 8 WHEN 0 THEN 'NY' WHEN 1 THEN NULL ELSE 'OR' END AS state, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 80 + 0.5::DOUBLE END AS latitude, CASE WHEN c_custkey % 10 <> 0 THEN CAST(-(c_custkey % 170) AS DOUBLE) END AS longitude,
  CASE c_custkey % 4 WHEN 0 THEN '2024-02-03' WHEN 2 THEN '2024-12-31' END AS grant_date, 'CN87' AS gridsquare, 291 AS dxcc, {_NONE},
  concat_ws(',', CASE WHEN c_custkey % 8 = 1 THEN 'state' END, CASE WHEN c_custkey % 10 = 0 THEN 'latitude,longitude' END, CASE WHEN c_custkey % 4 = 1 THEN 'grant_date' END) AS dirty FROM customer"""
