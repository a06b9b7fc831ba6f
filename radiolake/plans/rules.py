"""Decoding, naming and placing rules over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import places, scalars
from radiolake.operators import etl, forms, lookup
from radiolake.plans.activity import CONTACTS, contacts
from radiolake.plans.tables import table

QUERIES, SQL = {}, {}

_STATE = "CASE c_custkey % 9 WHEN 0 THEN ' or' WHEN 1 THEN 'AK' WHEN 2 THEN 'HI' WHEN 3 THEN 'AE' WHEN 4 THEN 'ZZ' WHEN 5 THEN 'GU' WHEN 6 THEN 'DC' WHEN 7 THEN 'VI' END"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, number, continent = scalars.entity(F.expr(_STATE))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("entity"), number.alias("dxcc"), continent.alias("continent"))


QUERIES["entities"] = entities
SQL["entities"] = """SELECT c_custkey, entity, CAST(dxcc AS INTEGER) AS dxcc, continent FROM customer LEFT JOIN (VALUES (0, 'United States of America', 291, 'NA'), (1, 'Alaska', 6, 'NA'), (2, 'Hawaii', 110, 'OC'), (3, 'Military (APO/FPO)', NULL, NULL),
  (5, 'Guam', 103, 'OC'), (6, 'United States of America', 291, 'NA'), (7, 'US Virgin Islands', 285, 'NA')) v(k, entity, dxcc, continent) ON k = c_custkey % 9"""

_TOWN = "CASE p_partkey % 5 WHEN 0 THEN \" St. John's\" WHEN 1 THEN 'Trois-Rivières ' WHEN 2 THEN 'Sainte-Anne / SAINT Paul' WHEN 3 THEN '' END"


def naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TOWN).alias("town"), "p_size", "p_brand")
    return rows.select(
        "p_partkey", places.place_key(F.col("town")).alias("place_key"), F.concat_ws("|", *scalars.address_parts(F.lit(" 1 main st"), F.col("town"), F.lit(None).cast("string"), F.concat((F.col("p_size") + 10000).cast("string"), F.lit("-1234")))).alias("address"),
        scalars.template_id(F.concat(F.lit("A_b! "), "p_brand", F.lit("-"))).alias("template"), scalars.initial_mapping(F.element_at(F.array(F.lit("SSB"), F.lit("cw"), F.lit("x")), (F.col("p_partkey") % 3 + 1).cast("int")), ["CW", "ssb", "Other"]).alias("mode"),
        scalars.initial_mapping(F.element_at(F.array(F.lit("20M"), F.lit("x")), (F.col("p_partkey") % 2 + 1).cast("int")), ["20m"]).alias("band"),
    )


QUERIES["naming"] = naming
SQL["naming"] = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ST JOHNS' WHEN 1 THEN 'TROIS RIVIERES' WHEN 2 THEN 'STE ANNE ST PAUL' ELSE '' END AS place_key,
  '1 MAIN ST|' || CASE p_partkey % 5 WHEN 0 THEN 'ST. JOHN''S' WHEN 1 THEN 'TROIS-RIVIÈRES' WHEN 2 THEN 'SAINTE-ANNE / SAINT PAUL' ELSE '' END || '||' || (p_size + 10000) AS address,
  'a_b-' || trim(regexp_replace(lower(p_brand), '[^a-z0-9_-]+', '-', 'g'), '-') AS template, CASE p_partkey % 3 WHEN 0 THEN 'ssb' WHEN 1 THEN 'CW' ELSE 'Other' END AS mode, CASE WHEN p_partkey % 2 = 0 THEN '20m' ELSE '' END AS band FROM part"""

QUERIES["band_order"] = lambda spark, sf_dir: forms.in_band_order(contacts(spark, sf_dir).select("uuid", F.when(F.col("uuid") % 7 != 0, F.col("band")).alias("band")), ["3", "1", "0"])
SQL["band_order"] = f"WITH {CONTACTS}, b AS (SELECT uuid, CASE WHEN uuid % 7 <> 0 THEN band END AS band FROM contacts) SELECT uuid, band, CAST(CASE band WHEN '3' THEN 0 WHEN '1' THEN 1 WHEN '0' THEN 2 ELSE 3 END AS INTEGER) AS place FROM b"

QUERIES["lookup_by_key"] = lambda spark, sf_dir: lookup.by_key(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("c_custkey")), table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
SQL["lookup_by_key"] = "SELECT o_orderkey, o_custkey * 2 AS c_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2"

#: A geocoder's answers to an order's address: for each line one, of these titles, types and qualifiers.
_ANSWERS = [
    ("66a Avenue, Edmonton, Alberta", "ca.Street", "INTERPOLATED_POSITION"), ("Gowdy Street, Town, Ontario", "ca.Address", "OTHER"), ("St. John's, Newfoundland and Labrador (City)", "ca.Geoname", ""),
    ("St Johns Lake, Newfoundland and Labrador (Lake)", "ca.Geoname", ""), ("Saint John's, newfoundland and labrador (Cape)", "ca.Geoname", ""), ("Ontario (Province)", "ca.Geoname", ""), ("Gowdy Avenue, Other, Alberta", "ca.Street", "OTHER"),
]


def geocode_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("l_partkey") % len(_ANSWERS) + 1).cast("int")
    answer = lambda i: F.element_at(F.array(*[F.lit(a[i]) for a in _ANSWERS]), at)
    key = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("position"), answer(0).alias("title"), answer(1).alias("type"), answer(2).alias("qualifier"), F.when(F.col("l_partkey") % 10 != 0, F.col("l_linenumber").cast("double")).alias("lat"), F.col("l_partkey").cast("double").alias("lon"),
        F.when(key % 2 == 0, "14088 66A Ave").otherwise("GOWDY ST APT 4").alias("street"), F.when(key % 5 != 0, "ST JOHNS").alias("city"), F.when(key % 4 < 2, "Alberta").when(key % 4 == 2, "Newfoundland and Labrador").alias("province"),
    )
    return etl.pick_places(rows, "l_orderkey")


QUERIES["geocode_picks"] = geocode_picks
#: Answer, the street that it may be, its province, whether it names the town, and whether it is populated.
_KNOWN = "(0, 'a', 'Alberta', false, false), (1, 'g', 'Ontario', false, false), (2, '', 'Newfoundland and Labrador', true, true), (3, '', 'Newfoundland and Labrador', false, false), (4, '', 'Newfoundland and Labrador', true, false), (5, '', 'Ontario', false, false), (6, 'g', 'Alberta', false, false)"
SQL["geocode_picks"] = f"""WITH k(a, street, place, town, populated) AS (VALUES {_KNOWN}),
r AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS position, a, CAST(l_linenumber AS DOUBLE) AS lat, CAST(l_partkey AS DOUBLE) AS lon, populated,
  l_partkey % 10 <> 0 AND coalesce(CASE WHEN l_orderkey % 4 < 2 THEN 'Alberta' WHEN l_orderkey % 4 = 2 THEN 'Newfoundland and Labrador' END = place, true) AS usable,
  street = CASE WHEN l_orderkey % 2 = 0 THEN 'a' ELSE 'g' END AS is_street, town AND l_orderkey % 5 <> 0 AS is_town FROM lineitem JOIN k ON a = l_partkey % 7),
s AS (SELECT l_orderkey, arg_min(lat, (position, lat, lon)) AS lat, arg_min(lon, (position, lat, lon)) AS lon, arg_min(CASE WHEN a = 0 THEN 'Street' ELSE 'Street_Approx' END, (position, lat, lon)) AS how FROM r WHERE usable AND is_street GROUP BY l_orderkey),
t AS (SELECT l_orderkey, arg_min(lat, (NOT populated, position, lat, lon)) AS lat, arg_min(lon, (NOT populated, position, lat, lon)) AS lon FROM r WHERE usable AND is_town GROUP BY l_orderkey)
SELECT o.l_orderkey, coalesce(s.lat, t.lat) AS lat, coalesce(s.lon, t.lon) AS lon, coalesce(s.how, CASE WHEN t.lat IS NOT NULL THEN 'City_Centroid' END) AS how FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN s USING (l_orderkey) LEFT JOIN t USING (l_orderkey)"""


# --- prompts, purged caches, blanked fields -------------------------------------------------------------------------

_PROMPTS = [{"name": "power", "required": True}, {"name": "note", "max_length": 5}, {"name": "club"}]


def export_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's answers to an export's prompts: its first lines' status, priority and comment."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    name = F.element_at(F.array(*[F.lit(p["name"]) for p in _PROMPTS]), F.col("l_linenumber").cast("int"))
    answer = F.when(F.col("l_partkey") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.repeat(F.lit("x"), (F.col("l_partkey") % 26).cast("int"))))
    return forms.unanswered(_PROMPTS, lines.select("l_orderkey", name.alias("name"), answer.alias("answer")), "l_orderkey")


QUERIES["export_prompts"] = export_prompts
SQL["export_prompts"] = """WITH p(k, name, required, most) AS (VALUES (1, 'power', true, 20), (2, 'note', false, 5), (3, 'club', false, 20)),
a AS (SELECT l_orderkey, l_linenumber AS k, max(CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_partkey % 26 END) AS n FROM lineitem GROUP BY ALL),
o AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber <= 3)
SELECT o.l_orderkey, name, CASE WHEN required AND coalesce(n, 0) = 0 THEN 'missing' ELSE 'too long' END AS problem FROM o CROSS JOIN p LEFT JOIN a ON a.l_orderkey = o.l_orderkey AND a.k = p.k WHERE (required AND coalesce(n, 0) = 0) OR n > most"""

QUERIES["cache_live"] = lambda spark, sf_dir: forms.cache_live(table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") * 1000).alias("expires_ms")), 50_000).select("o_orderkey")
SQL["cache_live"] = "SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0 AND o_custkey > 50"
QUERIES["blanked_fields"] = lambda spark, sf_dir: scalars.blanked(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), ["c_name", "c_acctbal"])
SQL["blanked_fields"] = "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer"
QUERIES["without_controls"] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.without_controls(F.concat(F.coalesce("text", F.lit("")), F.lit("\u200b\x07\n x\x85y\u00ad"))).cast("binary")).alias("plain_md5"))
SQL["without_controls"] = "SELECT doc_id, md5(regexp_replace(coalesce(text, '') || chr(8203) || chr(7) || chr(10) || ' x' || chr(133) || 'y' || chr(173), '[\\p{Cc}\\p{Cf}]+', ' ', 'g')) AS plain_md5 FROM documents"
