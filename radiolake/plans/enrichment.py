"""Cleaning, searching and enriching callsigns made from the keys and names of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import geo, scalars
from radiolake.operators import lookup, search, stats
from radiolake.plans.activity import CONTACTS, contacts
from radiolake.plans.places import POINTS, points
from radiolake.plans.tables import table
from radiolake.shared import shared_dir

QUERIES, SQL = {}, {}

# --- cleaning -------------------------------------------------------------------------------------------------------

_ENDS = ["/p", "/M", "/MM", "/QRP/", "/ANT", "/P/M", "/M/P", ""]
_TYPED = "' k' || c_custkey || CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDS)) + " END || ' '"
QUERIES["normalize_call"] = lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", scalars.normalize_call(F.expr(_TYPED)).alias("call"))
_N = f"rtrim(upper(trim({_TYPED})), '/')"
for _s in scalars.PORTABLE:
    _N = f"regexp_replace({_N}, '{_s}$', '')"
SQL["normalize_call"] = f"SELECT c_custkey, rtrim(trim({_N}), '/') AS call FROM customer"

_RAW = """CASE s_suppkey % 10 WHEN 0 THEN '"k' || s_suppkey || 'aa"' WHEN 1 THEN 'wØ' || s_suppkey WHEN 2 THEN 'n)' || s_suppkey || '!' WHEN 3 THEN 'no call' WHEN 4 THEN 'TEST' WHEN 5 THEN 'call'
  WHEN 6 THEN ' n/a' WHEN 7 THEN '`kÃ˜' || s_suppkey WHEN 8 THEN '(none)' ELSE 'va∅' || s_suppkey || '/w-1' END"""
QUERIES["clean_call"] = lambda spark, sf_dir: table(spark, sf_dir, "supplier").select("s_suppkey", scalars.clean_call(F.expr(_RAW)).alias("call"))
SQL["clean_call"] = """WITH n AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS n, s_suppkey % 10 AS k FROM supplier)
SELECT s_suppkey, CASE k WHEN 0 THEN 'K' || n || 'AA' WHEN 1 THEN 'W0' || n WHEN 2 THEN 'N0' || n || '1' WHEN 4 THEN 'TEST' WHEN 7 THEN 'K0' || n WHEN 8 THEN '9NONE0' WHEN 9 THEN 'VA0' || n || '/W-1' END AS call FROM n"""

QUERIES["suffixes"] = lambda spark, sf_dir: table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(scalars.suffixes(F.col("s_name"))).alias("suffix"))
SQL["suffixes"] = "SELECT s_suppkey, substr(s_name, i, length(s_name)) AS suffix FROM (SELECT *, unnest(range(1, length(s_name) + 1)) AS i FROM supplier)"

QUERIES["iso_ms"] = lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", scalars.iso_ms(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("at"))
SQL["iso_ms"] = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || '+00:00' AS at FROM events"

_DATE = """CASE o_orderkey % 4 WHEN 0 THEN {us} WHEN 1 THEN {iso} WHEN 2 THEN '13/45/2020' ELSE 'soon' END"""


def date_two_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.expr(_DATE.format(us="date_format(o_orderdate, 'M/d/yyyy')", iso="date_format(o_orderdate, 'yyyy-MM-dd')"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.iso_date(written).alias("day"))


QUERIES["date_two_formats"] = date_two_formats
SQL["date_two_formats"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"


def coerce_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr("CASE o_orderkey % 5 WHEN 0 THEN '06' WHEN 1 THEN '6.0' WHEN 2 THEN '6.5' WHEN 3 THEN CAST(o_custkey AS STRING) ELSE ' ' END").alias("zone"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'cn87uo' WHEN 1 THEN 'ZZ99' ELSE '' END").alias("grid"),
        F.expr("concat(' ', lower(o_orderpriority))").alias("name"),
    )
    columns, dirty = scalars.coerced(zone=(F.col("zone"), scalars.zone(F.col("zone"), 90)), grid=(F.col("grid"), scalars.gridsquare(F.col("grid"))), name=(F.col("name"), F.upper(scalars.text(F.col("name")))))
    return raw.select("o_orderkey", *columns, dirty.alias("dirty"))


QUERIES["coerce_record"] = coerce_record
SQL["coerce_record"] = """WITH z AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 3 THEN CASE WHEN o_custkey BETWEEN 1 AND 90 THEN o_custkey END END AS zone,
  CASE o_orderkey % 3 WHEN 0 THEN 'CN87' END AS grid, upper(o_orderpriority) AS name FROM orders)
SELECT o_orderkey, CAST(zone AS INTEGER) AS zone, grid, name, concat_ws(',', CASE WHEN zone IS NULL AND o_orderkey % 5 <> 4 THEN 'zone' END, CASE WHEN o_orderkey % 3 = 1 THEN 'grid' END) AS dirty FROM z"""

QUERIES["license_names"] = lambda spark, sf_dir: table(spark, sf_dir, "customer").select(
    "c_custkey",
    scalars.license_class(F.substring("c_mktsegment", 1, 4)).alias("license_class"),
    scalars.full_name(F.lit("Pat"), F.when(F.col("c_custkey") % 2 == 0, F.lit("q")).otherwise(F.lit(" ")), F.col("c_mktsegment"), F.lit(None).cast("string")).alias("full_name"),
    scalars.slug(F.concat("c_name", F.lit(" & "), "c_mktsegment")).alias("slug"),
)
SQL["license_names"] = """WITH c AS (SELECT *, substr(c_mktsegment, 1, 4) AS l FROM customer) SELECT c_custkey,
  CASE WHEN contains(l, 'D') THEN 'advanced' WHEN contains(l, 'E') THEN 'basic with honours' WHEN contains(l, 'A') THEN 'basic' ELSE '' END AS license_class,
  'PAT ' || CASE WHEN c_custkey % 2 = 0 THEN 'Q ' ELSE '' END || upper(c_mktsegment) AS full_name,
  trim(regexp_replace(lower(c_name || ' & ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM c"""

_CLEAN = "regexp_replace({}, '[^a-zA-Z0-9,_./-]', ''{})"
QUERIES["plain_text"] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.plain_text(F.coalesce("text", F.lit(""))).cast("binary")).alias("plain_md5"))
SQL["plain_text"] = f"SELECT doc_id, md5({_CLEAN.format("coalesce(text, '')", ", 'g'")}) AS plain_md5 FROM documents"

QUERIES["unmapped_values"] = lambda spark, sf_dir: stats.unmapped(contacts(spark, sf_dir), {"mode": {"click": "CW", "view": "SSB", "error": ""}, "band": {"1": "160m"}})
SQL["unmapped_values"] = f"WITH {CONTACTS} SELECT 'mode' AS key, mode AS value, count(*) AS n FROM contacts WHERE mode NOT IN ('click', 'view') GROUP BY mode UNION ALL SELECT 'band', band, count(*) FROM contacts WHERE band <> '1' GROUP BY band"
_MODE_MAP = {"CLICK": "CW", "view": "SSB", "Error": "RTTY"}
QUERIES["mapped_values"] = lambda spark, sf_dir: contacts(spark, sf_dir).groupBy(scalars.mapped(F.col("mode"), _MODE_MAP, "Other").alias("mapped")).agg(F.count("*").alias("n"))
SQL["mapped_values"] = f"WITH {CONTACTS} SELECT CASE mode WHEN 'click' THEN 'CW' WHEN 'view' THEN 'SSB' WHEN 'error' THEN 'RTTY' ELSE 'Other' END AS mapped, count(*) AS n FROM contacts GROUP BY 1"

QUERIES["clock_shift"] = lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", F.unix_millis(scalars.shifted(F.col("ts"), -1, 3, -30)).alias("at_ms"))
SQL["clock_shift"] = "SELECT event_id, epoch_us(ts - INTERVAL 1 DAY + INTERVAL 3 HOUR - INTERVAL 30 MINUTE) // 1000 AS at_ms FROM events"

# --- searching ------------------------------------------------------------------------------------------------------

_TERMS = ["00", "red", "9", "steel", "a", "zzz", "almond antique"]
#: What the seven sources know of each callsign; null where they don't know it.
_KNOWN = {
    "fd_last_year": "max(CASE WHEN p_partkey % 3 <> 0 THEN 2000 + p_size % 20 END)",
    "wfd_last_year": "max(CASE WHEN p_partkey % 4 = 0 THEN 2015 + p_size % 9 END)",
    "pota_hunter_qsos": "max(CASE WHEN p_size > 10 THEN p_partkey END)",
    "pota_activations": "max(CASE WHEN p_size < 20 THEN p_partkey % 500 END)",
    "lotw_last_upload": "max(CASE WHEN p_partkey % 5 < 3 THEN concat('2024-01-', lpad(concat(1 + p_size % 28, ''), 2, '0')) END)",
    "clublog": "max(CASE WHEN p_partkey % 6 <> 1 THEN 1 ELSE 0 END)",
    "clublog_last_qso": "max(CASE WHEN p_partkey % 6 > 3 THEN concat('2023-12-', lpad(concat(1 + p_size % 28, ''), 2, '0')) END)",
    "scp": "max(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END)",
}
_DATED = ("fd_last_year", "wfd_last_year", "pota_hunter_qsos", "pota_activations", "lotw_last_upload")


def partial_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven sources, each with its own order and limit, for several terms at once, through a stored index and its increment."""
    calls = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("call")).agg(*[F.expr(e).alias(n) for n, e in _KNOWN.items()])
    counted = sum((F.col(c).isNotNull().cast("int") for c in _DATED), F.col("clublog") + F.col("scp"))
    known = calls.withColumn("source_count", counted)
    path = shared_dir(spark)
    search.write_index(known.where("length(call) % 2 = 0"), path)
    search.extend_index(known, path)
    return search.by_source(search.in_index(spark, path, _TERMS).join(known, "call"))


QUERIES["partial_search_topk"] = partial_search
_ORDERS = {
    "fd": ("fd_last_year", "fd_last_year IS NOT NULL", "fd_last_year DESC"), "wfd": ("wfd_last_year", "wfd_last_year IS NOT NULL", "wfd_last_year DESC"),
    "pota_hunter": ("pota_hunter_qsos", "pota_hunter_qsos IS NOT NULL", "pota_hunter_qsos DESC"), "pota_activator": ("pota_activations", "pota_activations IS NOT NULL", "pota_activations DESC"),
    "lotw": ("lotw_last_upload", "lotw_last_upload IS NOT NULL", "lotw_last_upload DESC"), "clublog": ("clublog_last_qso", "clublog = 1", "clublog_last_qso IS NULL, clublog_last_qso DESC"),
    "scp": ("NULL", "scp = 1", "length(call), source_count DESC"),
}
_SEARCH = " UNION ALL ".join(
    f"""SELECT term, '{name}' AS source, CAST(place AS INTEGER) AS place, call, CAST(value AS VARCHAR) AS value, n > {search.SOURCE_LIMITS[name]} AS truncated FROM (SELECT term, call, {value} AS value,
  row_number() OVER (PARTITION BY term ORDER BY call <> term, {order}, call) AS place, count(*) OVER (PARTITION BY term) AS n FROM f WHERE {where}) WHERE place <= {search.SOURCE_LIMITS[name]}"""
    for name, (value, where, order) in _ORDERS.items()
)
SQL["partial_search_topk"] = f"""WITH k AS (SELECT lower(p_name) AS call, {", ".join(f"{e} AS {n}" for n, e in _KNOWN.items())} FROM part GROUP BY 1),
p AS (SELECT *, {" + ".join(f"({c} IS NOT NULL)::INT" for c in _DATED)} + clublog + scp AS source_count FROM k),
f AS (SELECT * FROM p, (SELECT unnest({_TERMS}) AS term) WHERE contains(call, term)) {_SEARCH}"""

QUERIES["match_rank_search"] = lambda spark, sf_dir: search.ranked_search(table(spark, sf_dir, "customer").select(F.col("c_name").alias("call"), (F.col("c_custkey") % 7).alias("source_count")), "11", 20)
SQL["match_rank_search"] = """SELECT c_name AS call, c_custkey % 7 AS source_count, CAST(CASE WHEN c_name = '11' THEN 0 WHEN starts_with(c_name, '11') THEN 1 ELSE 2 END AS INTEGER) AS match_rank
FROM customer WHERE contains(c_name, '11') ORDER BY match_rank, length(c_name), source_count DESC, c_name LIMIT 20"""


def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contacts(spark, sf_dir).withColumn("call", F.concat(F.lit("K"), F.col("operator").cast("string")))
    return search.latest(search.with_tokens(rows, "  VIEW k1 ", F.array("call", "band", "mode")), "qso_at", "uuid").select("uuid", "call", "mode")


QUERIES["token_search"] = token_search
SQL["token_search"] = f"""WITH {CONTACTS} SELECT uuid, 'K' || operator AS call, mode FROM contacts
WHERE contains(lower(concat_ws('|', 'K' || operator, band, mode)), 'view') AND contains(lower(concat_ws('|', 'K' || operator, band, mode)), 'k1') ORDER BY qso_at DESC, uuid DESC LIMIT 50"""

# --- enriching ------------------------------------------------------------------------------------------------------


def chain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources over disjoint and shared keys: all customers (odd numbers), all parts, all suppliers (moved up)."""
    calls = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.col("l_suppkey")).alias("call")).unionByName(table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 7).alias("call")))
    first = table(spark, sf_dir, "customer").select((2 * F.col("c_custkey") + 1).alias("call"), F.col("c_name").alias("name"))
    second = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("call"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 10 == 0, F.lit("unavailable")).alias("error"))
    third = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 11).alias("call"), F.col("s_name").alias("name"))
    return lookup.chain(calls, [("first", first), ("second", second), ("third", third)], "call")


QUERIES["chain_lookup"] = chain_lookup
SQL["chain_lookup"] = """WITH k AS (SELECT l_partkey + l_suppkey AS call FROM lineitem UNION SELECT o_orderkey + 7 FROM orders),
j AS (SELECT k.call, c.c_name, CASE WHEN p_partkey % 10 <> 0 THEN p.p_name END AS p_name, s.s_name, p_partkey % 10 = 0 AS bad FROM k
  LEFT JOIN customer c ON 2 * c.c_custkey + 1 = k.call LEFT JOIN part p ON p.p_partkey = k.call LEFT JOIN supplier s ON s.s_suppkey * 11 = k.call)
SELECT call, coalesce(c_name, p_name, s_name) AS name, CASE WHEN c_name IS NOT NULL THEN 'first' WHEN p_name IS NOT NULL THEN 'second' WHEN s_name IS NOT NULL THEN 'third' END AS source,
  CASE WHEN coalesce(c_name, p_name, s_name) IS NULL AND bad THEN 'unavailable' END AS error FROM j"""

QUERIES["state_single_section"] = lambda spark, sf_dir: lookup.single_valued(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).alias("state"), F.col("s_nationkey").alias("section")), "state", "section")
SQL["state_single_section"] = "SELECT s_suppkey % 60 AS state, min(s_nationkey) AS section FROM supplier GROUP BY 1 HAVING count(DISTINCT s_nationkey) = 1"


def section_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed coordinates, then a typed section, then a typed grid; each recalculates or blanks its own fields."""
    base = points(spark, sf_dir).select(
        "c_custkey", "lat", "lon", F.col("c_nationkey").cast("string").alias("section"), geo.maidenhead(F.col("lat"), F.col("lon")).alias("grid"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN 10.5D WHEN c_custkey % 12 = 1 THEN lat END").alias("typed_lat"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN -20.5D WHEN c_custkey % 12 = 1 THEN lon END").alias("typed_lon"),
        F.expr("CASE WHEN c_custkey % 6 < 2 THEN 'X7' END").alias("typed_section"),
        F.expr("CASE WHEN c_custkey % 10 < 5 THEN 'CN87' END").alias("typed_grid"),
    )
    typed = (F.col("typed_lat"), F.col("typed_lon"))
    center = geo.grid_center(F.col("typed_grid"))
    nothing = F.lit(None).cast("string")
    branches = [
        ((F.col("typed_lat") != F.col("lat")) | (F.col("typed_lon") != F.col("lon")), {"lat": typed[0], "lon": typed[1], "grid": geo.maidenhead(*typed)}),
        (F.col("typed_section") != F.col("section"), {"section": F.col("typed_section"), "grid": nothing}),
        (F.col("typed_grid") != F.col("grid"), {"lat": center[0].cast("double"), "lon": center[1].cast("double"), "grid": F.col("typed_grid"), "section": nothing}),
    ]
    return base.select("c_custkey", *lookup.override({c: F.col(c) for c in ("lat", "lon", "section", "grid")}, branches))


QUERIES["section_override"] = section_override
_CELL = """substr('ABCDEFGHIJKLMNOPQR', CAST(floor((lon + 180) / 20) AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQR', CAST(floor((lat + 90) / 10) AS INT) + 1, 1)
  || CAST(floor((lon + 180) % 20 / 2) AS INT) || CAST(floor((lat + 90) % 10) AS INT)"""
SQL["section_override"] = f"""WITH {POINTS}, g AS (SELECT *, CAST(c_nationkey AS VARCHAR) AS section, {_CELL} AS grid, CASE WHEN c_custkey % 4 = 0 THEN 1 WHEN c_custkey % 6 < 2 THEN 2
  WHEN c_custkey % 10 < 5 AND {_CELL} <> 'CN87' THEN 3 ELSE 0 END AS b FROM pts)
SELECT c_custkey, CASE b WHEN 1 THEN 10.5 WHEN 3 THEN 47.5 ELSE lat END AS lat, CASE b WHEN 1 THEN -20.5 WHEN 3 THEN -123.0 ELSE lon END AS lon,
  CASE b WHEN 2 THEN 'X7' WHEN 3 THEN NULL ELSE section END AS section, CASE b WHEN 1 THEN 'HK90' WHEN 2 THEN NULL WHEN 3 THEN 'CN87' ELSE grid END AS grid FROM g"""
