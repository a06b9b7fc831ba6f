"""Submissions, display lines, remembered values, and checks of placed addresses over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import geo
from radiolake.operators import etl, log, lookup
from radiolake.plans.activity import CONTACTS, contacts
from radiolake.plans.places import HOME, POINTS, points
from radiolake.plans.tables import table
from radiolake.sources import adif, exports

QUERIES, SQL = {}, {}


def submission_adif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the parks' format, by the format's own builder: prompts, the event, columns, custom fields, park tags."""
    rows = contacts(spark, sf_dir).withColumn("fields", F.create_map(F.lit("class"), F.concat(F.lit("3"), F.col("band")))).withColumn("their_park", F.when(F.col("uuid") % 4 == 0, F.concat(F.lit("US-"), F.col("band"))))
    order = ["station", "mode", "class", "power", "nothing", "my_park", "their_park"]
    return rows.select("uuid", exports.pota_line(rows, order, {"power": ""}, {"power": "QRP", "station": "K7X", "my_park": "US-9"}).alias("record"))


QUERIES["submission_adif"] = submission_adif
SQL["submission_adif"] = f"""WITH {CONTACTS} SELECT uuid, '<STATION:3>K7X <MODE:' || length(mode) || '>' || mode || ' <CLASS:2>3' || band || ' <MY_SIG:4>POTA <MY_SIG_INFO:4>US-9 <MY_POTA_REF:4>US-9' || CASE WHEN uuid % 4 = 0 THEN ' <SIG:4>POTA <SIG_INFO:4>US-' || band || ' <POTA_REF:4>US-' || band ELSE '' END || ' <EOR>' AS record FROM contacts"""

QUERIES["export_name"] = lambda spark, sf_dir: exports.first_day(contacts(spark, sf_dir).select(F.when(F.col("uuid") % 5 != 0, F.date_format("qso_at", "yyyy-MM-dd HH:mm:ss")).otherwise("soon").alias("at")), "at", "log")
SQL["export_name"] = f"WITH {CONTACTS} SELECT 'log-' || strftime(min(qso_at), '%Y%m%d') || '.adi' AS file_name FROM contacts WHERE uuid % 5 <> 0"


def display_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = [F.lit(x) for x in HOME]
    km, degrees = geo.kilometres(*here, F.col("lat"), F.col("lon")), geo.bearing(*here, F.col("lat"), F.col("lon"))
    known = lambda every, c: F.when(F.col("c_custkey") % every != 0, c)
    line = exports.location_line(known(2, F.lit("Here")), known(3, km), known(5, degrees))
    return points(spark, sf_dir).select("c_custkey", line.alias("line"), exports.operator_line(known(4, F.lit("PAT")), known(7, F.lit("basic with honours"))).alias("operator"))


QUERIES["display_lines"] = display_lines
_A = "(pow(sin(radians(lat - 45.0) / 2), 2) + cos(radians(45.0)) * cos(radians(lat)) * pow(sin(radians(lon + 123.0) / 2), 2))"
SQL["display_lines"] = f"""WITH {POINTS}, k AS (SELECT c_custkey, CAST(floor(floor(6371.0 * 2 * atan2(sqrt({_A}), sqrt(1 - {_A}))) * 0.621371::DOUBLE + 0.5) AS BIGINT) AS mi,
  CAST(floor((degrees(atan2(sin(radians(lon + 123.0)) * cos(radians(lat)), cos(radians(45.0)) * sin(radians(lat)) - sin(radians(45.0)) * cos(radians(lat)) * cos(radians(lon + 123.0)))) + 360) % 360 + 0.5) AS BIGINT) % 360 AS deg FROM pts),
l AS (SELECT c_custkey, concat_ws(' / ', CASE WHEN c_custkey % 3 <> 0 THEN format('{{:,}}', mi) || 'mi' END, CASE WHEN c_custkey % 5 <> 0 THEN deg || '°' END) AS inside FROM k)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' WHEN inside = '' THEN 'Here' ELSE 'Here (' || inside || ')' END AS line,
  CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 7 <> 0 THEN 'PAT (Basic With Honours)' WHEN c_custkey % 4 <> 0 THEN 'PAT' WHEN c_custkey % 7 <> 0 THEN 'Basic With Honours' ELSE '' END AS operator FROM l"""


def autofill(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    record = {
        "license_type": F.when(key % 3 == 0, "club").otherwise("person"), "name": F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit(" smith")), "state": F.when(key % 2 == 0, "OR").otherwise("ZZ"), "continent": F.when(key % 4 == 0, "na").otherwise("XX"),
        "country": F.when(key % 5 != 0, "Land").otherwise(""), "gridsquare": F.lit("CN87"), "county": F.lit(None).cast("string"), "distance": (key % 3).cast("int"), "itu_zone": F.when(key % 2 == 0, 6), "cq_zone": F.lit(None).cast("int"),
    }
    return table(spark, sf_dir, "customer").select("c_custkey", *lookup.autofill(record))


QUERIES["autofill"] = autofill
SQL["autofill"] = """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'OR' END AS state, CASE WHEN c_custkey % 4 = 0 THEN 'NA' END AS continent,
  CASE WHEN c_custkey % 5 <> 0 THEN 'Land' END AS country, 'CN87' AS gridsquare, CAST(NULL AS VARCHAR) AS county, CAST(c_custkey % 3 AS VARCHAR) AS distance, CASE WHEN c_custkey % 2 = 0 THEN '6' END AS itu_zone, CAST(NULL AS VARCHAR) AS cq_zone FROM customer"""


QUERIES["latest_contact"] = lambda spark, sf_dir: log.latest_of(contacts(spark, sf_dir), "operator", ["uuid", "mode", "band"])
SQL["latest_contact"] = f"""WITH {CONTACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY qso_at DESC, uuid DESC) AS r FROM contacts) SELECT operator, uuid, mode, band FROM r WHERE r = 1"""


def province_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("place", F.when(F.col("c_custkey") % 4 != 0, F.format_string("%d,%d", F.floor("lat"), F.floor("lon"))))
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_name").alias("point"), F.col("s_acctbal").alias("area"), F.col("s_suppkey").alias("ident"))
    return etl.largest_member(rows, members, "c_nationkey", "place").select("c_custkey", "place")


QUERIES["province_fallback"] = province_fallback
SQL["province_fallback"] = f"""WITH {POINTS}, f AS (SELECT s_nationkey, arg_max(s_name, (s_acctbal, s_suppkey)) AS fallback FROM supplier GROUP BY s_nationkey)
SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN CAST(floor(lat) AS BIGINT) || ',' || CAST(floor(lon) AS BIGINT) ELSE fallback END AS place FROM pts LEFT JOIN f ON s_nationkey = c_nationkey"""


_WIDE, _HIGH = 6.0, 4.0
_AREA = "concat(substr('ABCEGHJKLMNPRSTVXY', n_nationkey % 18 + 1, 1), n_nationkey % 10, 'A')"


def postal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' points against boxes of their postal areas, which are named by nation."""
    y, x = F.col("n_nationkey") * 3.0 - 30, F.col("n_nationkey") * 10.0 - 120
    corner = lambda v, h: F.struct((y + v * _HIGH / 2).alias("lat"), (x + h * _WIDE / 2).alias("lon"))
    box = F.array(F.array(*[corner(v, h) for v, h in ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))]))
    areas = table(spark, sf_dir, "nation").where("n_nationkey < 18").select(F.expr(_AREA).alias("area"), box.alias("rings"), y.alias("mid_lat"), x.alias("mid_lon"), (F.col("n_regionkey") * 4_000_000.0).alias("km2"))
    rows = points(spark, sf_dir).withColumn("n_nationkey", F.col("c_nationkey")).select(
        "c_custkey", F.concat(F.lower(F.expr(_AREA)), F.lit(" 1a1")).alias("postal"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'ON' WHEN c_custkey % 3 = 1 THEN ' ' END").alias("province"),
        *[F.when(F.col("c_custkey") % 5 != 0, F.col(c)).alias(c) for c in ("lat", "lon")], F.lit("Street").alias("how"),
    )
    return etl.postal_checked(rows, areas).select("c_custkey", "lat", "lon", "how")


QUERIES["postal_check"] = postal_check
SQL["postal_check"] = f"""WITH {POINTS}, r AS (SELECT c_custkey, {_AREA} AS area, c_custkey % 3 = 0 AS on_only, CASE WHEN c_custkey % 5 <> 0 THEN lat END AS lat, CASE WHEN c_custkey % 5 <> 0 THEN lon END AS lon FROM (SELECT *, c_nationkey AS n_nationkey FROM pts)),
a AS (SELECT {_AREA} AS area, n_nationkey * 3.0::DOUBLE - 30 AS my, n_nationkey * 10.0::DOUBLE - 120 AS mx, n_regionkey * 4000000.0::DOUBLE AS km2 FROM nation WHERE n_nationkey < 18),
d AS (SELECT r.*, my, mx, km2, sqrt(pow(greatest(0, abs(lat - my) - {_HIGH / 2}), 2) + pow(greatest(0, abs(lon - mx) - {_WIDE / 2}), 2)) * 111.19::DOUBLE AS km FROM r LEFT JOIN a USING (area)),
m AS (SELECT *, my IS NOT NULL AND (NOT on_only OR substr(area, 1, 1) IN ('K', 'L', 'M', 'N', 'P')) AND (lat IS NULL OR km > greatest(5.0, sqrt(km2 / pi()))) AS moved FROM d)
SELECT c_custkey, CASE WHEN moved THEN my ELSE lat END AS lat, CASE WHEN moved THEN mx ELSE lon END AS lon, CASE WHEN moved THEN 'FSA_Centroid' ELSE 'Street' END AS how FROM m"""


def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields of a template that a contact leaves blank, in its columns or its map; tombstones are exempt."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderstatus END").alias("section"), F.create_map(F.lit("class"), F.expr("CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '3A' END")).alias("fields"), (F.col("o_orderkey") % 5 == 0).alias("deleted"))
    template = [{"name": "section", "entry": True, "required": True}, {"name": "class", "entry": True, "required": True}, {"name": "power", "entry": True}, {"name": "note", "required": True}]
    return log.missing_required(rows, template).select("o_orderkey", "missing")


QUERIES["required_fields"] = required_fields
SQL["required_fields"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'section' END, CASE WHEN o_orderkey % 6 = 0 THEN 'class' END) END AS missing FROM orders"
