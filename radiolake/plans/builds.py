"""Builds of several phases over the given tables: a country's licensees, the table of callsigns, files of submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.operators import builds, search
from radiolake.plans.activity import CONTACTS, contacts
from radiolake.plans.places import REGIONS
from radiolake.plans.tables import table
from radiolake.shared import shared_dir
from radiolake.sources import exports
from radiolake.streaming import jobs

QUERIES, SQL = {}, {}

# --- licensees -------------------------------------------------------------------------------------------------------

_WIDE, _HIGH = 6.0, 4.0
_PROVINCES = "CASE o_custkey % 6 WHEN 0 THEN 'QC' WHEN 1 THEN 'ON' WHEN 2 THEN ' on' WHEN 3 THEN 'YT' WHEN 4 THEN 'ZZ' END"
_STREETS = "CASE WHEN o_custkey % 4 <> 0 THEN concat('Street ', o_custkey % 300) ELSE ' ' END"
_TOWNS = "CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('Québec ', o_custkey % 90) ELSE concat('Quebec ', o_custkey % 90) END"
_AREA = "concat(substr('GHJKLMNPRSTVXYABCE', n_nationkey % 18 + 1, 1), n_nationkey % 10, 'A')"
#: Divisions: each region of the map with its province and an inner point.
_DIVISIONS = [(province, f"c{part}", part, rings, size, lat, lon) for (_, part, rings), (province, size, lat, lon) in zip(REGIONS, [("QC", 900.0, 5.0, 5.0), ("ON", 80.0, 15.0, -20.0), ("ON", 700.0, 40.0, 60.0), ("BC", 500.0, 30.0, 170.0), ("BC", 500.0, 30.0, -170.0)], strict=True)]


def canadian_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for licensees, parts for the two caches, nations for postal areas: the build's published table."""
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    licensees = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey", "left").select(
        F.col("o_orderkey").alias("usi"), F.expr(_STREETS).alias("street"), F.expr(_TOWNS).alias("city"), F.expr(_PROVINCES).alias("state"), F.expr(f"CASE WHEN o_custkey % 7 < 4 THEN concat(lower({_AREA}), ' 1a1') END").alias("postal")
    )
    found = lambda how, turn: [(F.col("p_size") > 15).alias("matched"), F.col("p_size").alias("fetched_at"), ((F.col("p_partkey") + turn) % 60 + 0.25).alias("lat"), ((F.col("p_partkey") + turn) * 7 % 300 - 149.75).alias("lon"), F.lit(how).alias("how")]
    streets = part.select(builds.street_key(F.expr("concat('street ', p_partkey % 300)"), F.expr("concat('QUEBEC ', p_partkey % 90)"), F.lit("on")).alias("key"), *found("Street", 0))
    towns = part.select(builds.town_key(F.expr("concat('quebec ', p_partkey % 90)"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'QC' ELSE 'ON' END")).alias("key"), *found("City_Centroid", 11))
    y, x = F.col("n_nationkey") * 3.0 - 30, F.col("n_nationkey") * 10.0 - 120
    corner = lambda v, h: F.struct((y + v * _HIGH / 2).alias("lat"), (x + h * _WIDE / 2).alias("lon"))
    box = F.array(F.array(*[corner(v, h) for v, h in ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))]))
    areas = table(spark, sf_dir, "nation").where("n_nationkey < 18").select(F.expr(_AREA).alias("area"), box.alias("rings"), y.alias("mid_lat"), x.alias("mid_lon"), (F.col("n_regionkey") * 4_000_000.0).alias("km2"))
    divisions = spark.createDataFrame(_DIVISIONS, "province string, county string, position int, rings array<array<struct<lat:double,lon:double>>>, area double, mid_lat double, mid_lon double")
    counties = spark.createDataFrame([("ON", "c2", "GTA"), ("ON", "c3", "ONE")], "state string, county string, section string")
    phases = builds.canadian(licensees, streets, towns, areas, divisions, counties, {"licensees": sf_dir, "streets": sf_dir, "towns": sf_dir, "areas": sf_dir})
    built = builds.run(spark, shared_dir(spark), phases, builds.whole("usi", 0))
    return built.select("usi", "how", "lat", "lon", "county", "section", "dxcc_id", "continent")


QUERIES["canadian_build"] = canadian_build
_EDGE = ", ".join(f"({p}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for _, p, rings in REGIONS for r in rings for a, b in zip(r, r[1:], strict=False))
_HITS = "arg_max((p_partkey + {turn}) % 60, (p_size, (p_partkey + {turn}) % 60, (p_partkey + {turn}) * 7 % 300)) + 0.25::DOUBLE AS {n}lat, arg_max((p_partkey + {turn}) * 7 % 300, (p_size, (p_partkey + {turn}) % 60, (p_partkey + {turn}) * 7 % 300)) - 149.75::DOUBLE AS {n}lon"
SQL["canadian_build"] = f"""WITH l AS (SELECT o_orderkey AS usi, upper(trim({_STREETS})) AS street, upper(strip_accents({_TOWNS})) AS town, upper({_TOWNS}) AS spelled, upper(trim({_PROVINCES})) AS state, trim({_PROVINCES}) AS province, CASE WHEN o_custkey % 7 < 4 THEN {_AREA} END AS area
  FROM (SELECT orders.*, c_nationkey AS n_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey)),
s AS (SELECT 'STREET ' || p_partkey % 300 AS street, 'QUEBEC ' || p_partkey % 90 AS town, {_HITS.format(turn=0, n="s_")} FROM part WHERE p_size > 15 GROUP BY 1, 2),
t AS (SELECT 'QUEBEC ' || p_partkey % 90 AS town, CASE WHEN p_partkey % 2 = 0 THEN 'QC' ELSE 'ON' END AS state, {_HITS.format(turn=11, n="t_")} FROM part WHERE p_size > 15 GROUP BY 1, 2),
a AS (SELECT {_AREA} AS area, n_nationkey * 3.0::DOUBLE - 30 AS my, n_nationkey * 10.0::DOUBLE - 120 AS mx, n_regionkey * 4000000.0::DOUBLE AS km2 FROM nation WHERE n_nationkey < 18),
p AS (SELECT l.*, coalesce(s_lat, t_lat) AS lat, coalesce(s_lon, t_lon) AS lon, CASE WHEN s_lat IS NOT NULL THEN 'Street' WHEN t_lat IS NOT NULL THEN 'City_Centroid' END AS how
  FROM l LEFT JOIN s ON s.street = l.street AND s.town = l.spelled AND l.state = 'ON' LEFT JOIN t ON t.town = l.town AND t.state = l.state),
d AS (SELECT p.*, my, mx, my IS NOT NULL AND (province IS NULL OR CASE substr(p.area, 1, 1) WHEN 'G' THEN province = 'QC' WHEN 'H' THEN province = 'QC' WHEN 'J' THEN province = 'QC' WHEN 'K' THEN upper(province) = province AND province = 'ON' WHEN 'L' THEN province = 'ON' WHEN 'M' THEN province = 'ON' WHEN 'N' THEN province = 'ON' WHEN 'P' THEN province = 'ON' WHEN 'Y' THEN province = 'YT' ELSE false END)
  AND (lat IS NULL OR sqrt(pow(greatest(0, abs(lat - my) - {_HIGH / 2}), 2) + pow(greatest(0, abs(lon - mx) - {_WIDE / 2}), 2)) * 111.19::DOUBLE > greatest(5.0, sqrt(km2 / pi()))) AS moved FROM p LEFT JOIN a ON a.area = p.area),
q AS (SELECT usi, state, CASE WHEN moved THEN my WHEN lat IS NOT NULL THEN lat WHEN state = 'QC' THEN 5.0 WHEN state = 'ON' THEN 40.0 END AS lat, CASE WHEN moved THEN mx WHEN lat IS NOT NULL THEN lon WHEN state = 'QC' THEN 5.0 WHEN state = 'ON' THEN 60.0 END AS lon,
  CASE WHEN moved THEN 'FSA_Centroid' WHEN lat IS NOT NULL THEN how WHEN state IN ('QC', 'ON') THEN 'Province_Centroid' END AS how FROM d),
w AS (SELECT DISTINCT lat, lon FROM q WHERE how <> 'Province_Centroid'), e(part, y1, x1, y2, x2) AS (VALUES {_EDGE}),
j AS (SELECT *, greatest(0.0, least(1.0, ((lat - y1) * (y2 - y1) + (lon - x1) * (x2 - x1)) / ((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1)))) AS u FROM w, e),
n AS (SELECT lat, lon, part, count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside, min(sqrt((y1 + u * (y2 - y1) - lat) * (y1 + u * (y2 - y1) - lat) + (x1 + u * (x2 - x1) - lon) * (x1 + u * (x2 - x1) - lon))) AS far FROM j GROUP BY lat, lon, part),
c AS (SELECT lat, lon, arg_min('c' || part, (CASE WHEN inside THEN 0.0 ELSE far END, CASE WHEN inside THEN -part ELSE part END)) AS county FROM n GROUP BY lat, lon)
SELECT usi, how, q.lat AS lat, q.lon AS lon, county, CASE WHEN state = 'QC' THEN 'QC' WHEN state = 'YT' THEN 'TER' WHEN state = 'ON' AND county = 'c2' THEN 'GTA' WHEN state = 'ON' AND county = 'c3' THEN 'ONE' END AS section, 1 AS dxcc_id, 'NA' AS continent
FROM q LEFT JOIN c ON c.lat = q.lat AND c.lon = q.lon AND how <> 'Province_Centroid'"""

# --- callsigns --------------------------------------------------------------------------------------------------------


def _call_index(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The table of callsigns after two runs: the second brings newer values, callsigns of its own, and not all sources."""
    orders = table(spark, sf_dir, "orders").withColumn("call", F.concat(F.lit("K"), F.col("o_custkey").cast("string"), F.lit("AB")))
    of = lambda rows, value: orders.where(rows).groupBy("call", "o_custkey").agg(value)
    fd = of("o_orderstatus = 'F'", F.max(F.dayofmonth("o_orderdate")).alias("fd_last_year"))
    lotw = of("o_orderstatus = 'O'", F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("lotw_last_upload"))
    first = {"fd": fd, "lotw": lotw, "scp": of("o_orderstatus = 'P'", F.lit(1).alias("scp"))}
    newer = fd.withColumn("fd_last_year", F.col("fd_last_year") + F.when(F.col("o_custkey") % 2 == 0, 3).otherwise(-3))
    hunters = of("o_orderpriority = '1-URGENT'", F.count("*").alias("pota_hunter_qsos"))
    builds.call_index(spark, path, {name: (df.where("o_custkey % 3 <> 0"), sf_dir) for name, df in first.items()}, "2024-01-01")
    return builds.call_index(spark, path, {"fd": (newer, f"{sf_dir}, newer"), "hunters": (hunters, sf_dir)}, "2024-02-01")


QUERIES["call_index_build"] = lambda spark, sf_dir: _call_index(spark, sf_dir, shared_dir(spark)).select("call", "fd_last_year", "pota_hunter_qsos", "lotw_last_upload", "scp", "first_seen", "last_seen", "source_count")
_CALLS = """o AS (SELECT o_custkey AS k, max(day(o_orderdate)) FILTER (WHERE o_orderstatus = 'F') AS fd, strftime(max(o_orderdate) FILTER (WHERE o_orderstatus = 'O'), '%Y-%m-%d') AS lotw, count(*) FILTER (WHERE o_orderstatus = 'P') > 0 AS scp,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY o_custkey), g AS (SELECT *, k % 3 <> 0 AND (fd IS NOT NULL OR lotw IS NOT NULL OR scp) AS one, fd IS NOT NULL OR n > 0 AS two FROM o)"""
SQL["call_index_build"] = f"""WITH {_CALLS}, r AS (SELECT 'K' || k || 'AB' AS call, CASE WHEN k % 2 = 0 THEN fd + 3 WHEN k % 3 <> 0 THEN fd ELSE fd - 3 END AS fd_last_year, nullif(n, 0) AS pota_hunter_qsos, CASE WHEN k % 3 <> 0 THEN lotw END AS lotw_last_upload,
  CAST(CASE WHEN k % 3 <> 0 AND scp THEN 1 ELSE 0 END AS BIGINT) AS scp, CASE WHEN one THEN '2024-01-01' ELSE '2024-02-01' END AS first_seen, CASE WHEN two THEN '2024-02-01' ELSE '2024-01-01' END AS last_seen FROM g WHERE one OR two)
SELECT *, CAST((fd_last_year IS NOT NULL)::INT + (pota_hunter_qsos IS NOT NULL)::INT + (lotw_last_upload IS NOT NULL)::INT + scp AS INTEGER) AS source_count FROM r"""


def call_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callsigns found through the index that the two runs left, its increment included."""
    path = shared_dir(spark)
    _call_index(spark, sf_dir, path)
    return search.in_index(spark, f"{path}/suffixes", ["1A", "77", "K2"])


QUERIES["call_index_search"] = call_index_search
SQL["call_index_search"] = f"""WITH {_CALLS} SELECT term, 'K' || k || 'AB' AS call FROM g, (VALUES ('1A'), ('77'), ('K2')) t(term) WHERE (one OR two) AND contains('K' || k || 'AB', term)"""

# --- submissions and copies --------------------------------------------------------------------------------------------

_CONFIG = {"fields": ["remote_callsign", "qso_at", "band", "mode", "class", "my_park", "station_callsign", "their_park", "section"], "tags": {"class": "CLASS"}, "mode_map": {"click": "CW", "view": "PH"}, "bands": ["4", "2"]}
_PROMPTS, _META = {"my_park": "US-9", "my_class": "3A"}, {"station_callsign": "K7X"}


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    park = F.when(F.col("uuid") % 4 == 0, F.concat(F.lit("US-"), F.col("band"))).otherwise(" ")
    fields = F.create_map(F.lit("class"), F.concat(F.lit("3"), F.col("band")), F.lit("their_park"), park)
    return contacts(spark, sf_dir).withColumns({"fields": fields, "remote_callsign": F.concat(F.lit(" W"), F.col("operator").cast("string"))})


def submission_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contact's record in the two formats that have records, and both files' names."""
    rows = _entries(spark, sf_dir)
    made = {f: exports.FORMATS[f]["build"](rows, _CONFIG, _PROMPTS, _META).select("uuid", F.col("record").alias(f"{f}_record")) for f in ("adif", "pota")}
    name = lambda f: exports.FORMATS[f]["file_name"](rows, _PROMPTS, _META).scalar()
    return made["adif"].join(made["pota"], "uuid").select("*", name("adif").alias("adif_file"), name("pota").alias("pota_file"))


QUERIES["submission_formats"] = submission_formats
_HEAD = """'<CALL:' || length('W' || operator) || '>W' || operator || ' <QSO_DATE:8>' || strftime(qso_at, '%Y%m%d') || ' <TIME_ON:6>' || strftime(qso_at, '%H%M%S') || ' <BAND:1>' || band || CASE mode WHEN 'click' THEN ' <MODE:2>CW' WHEN 'view' THEN ' <MODE:2>PH' ELSE '' END || ' <CLASS:2>3' || band"""
SQL["submission_formats"] = f"""WITH {CONTACTS} SELECT uuid, {_HEAD} || ' <APP_RADIOLAKE_MY_PARK:4>US-9 <STATION_CALLSIGN:3>K7X' || CASE WHEN uuid % 4 = 0 THEN ' <APP_RADIOLAKE_THEIR_PARK:4>US-' || band ELSE '' END || ' <EOR>' AS adif_record,
  {_HEAD} || ' <MY_SIG:4>POTA <MY_SIG_INFO:4>US-9 <MY_POTA_REF:4>US-9 <STATION_CALLSIGN:3>K7X' || CASE WHEN uuid % 4 = 0 THEN ' <SIG:4>POTA <SIG_INFO:4>US-' || band || ' <POTA_REF:4>US-' || band ELSE '' END || ' <EOR>' AS pota_record,
  'K7X-' || (SELECT year(min(qso_at)) FROM contacts) || '.adi' AS adif_file, 'K7X@US-9-' || (SELECT strftime(min(qso_at), '%Y%m%d') FROM contacts) || '.adi' AS pota_file FROM contacts"""


def submission_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, form = _entries(spark, sf_dir), exports.FORMATS["dupesheet"]
    return form["build"](rows, _CONFIG, _PROMPTS, _META).groupBy("band_rank", "band", "mode", "kind", "line").agg(F.count("*").alias("n")).withColumn("file_name", form["file_name"](rows, _PROMPTS, _META).scalar())


QUERIES["submission_sheet"] = submission_sheet
SQL["submission_sheet"] = f"""WITH {CONTACTS}, c AS (SELECT CAST(CASE band WHEN '4' THEN 1 WHEN '2' THEN 2 ELSE 3 END AS INTEGER) AS band_rank, band, CASE mode WHEN 'click' THEN 'CW' ELSE 'PH' END AS mode, 'W' || operator AS call FROM contacts WHERE mode IN ('click', 'view')),
l AS (SELECT 0 AS band_rank, '' AS band, '' AS mode, 0 AS kind, 'Call Used: K7X  Class: 3A  ARRL Section: ' AS line, 1 AS n UNION ALL SELECT DISTINCT band_rank, band, mode, 0, band || ' ' || mode, 1 FROM c
  UNION ALL SELECT band_rank, band, mode, 1, call, count(*) FROM c GROUP BY ALL UNION ALL SELECT band_rank, band, mode, 2, 'Total: ' || count(*), 1 FROM c GROUP BY ALL)
SELECT *, (SELECT year(min(qso_at)) FROM contacts) || '-FD-K7X.dup' AS file_name FROM l"""


def gated_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a log that grows by operator: a tick without a newer contact copies nothing. Rows of each copy."""
    rows, path = contacts(spark, sf_dir).withColumn("at", F.unix_micros(F.col("qso_at").cast("timestamp"))), shared_dir(spark)
    for tick, seen in enumerate([rows.where("operator % 3 = 0"), rows.where("operator % 3 = 0"), rows]):
        latest = seen.agg(F.max("at")).first()[0]
        if latest is not None:
            jobs.change_gated(spark, path, latest, lambda seen=seen, tick=tick: exports.backup(seen, f"{path}/copies", "log", f"tick={tick}"))
    return spark.read.option("recursiveFileLookup", True).schema(rows.schema).parquet(f"{path}/copies").groupBy("operator").agg(F.count("*").alias("n"))


QUERIES["gated_backup"] = gated_backup
SQL["gated_backup"] = f"""WITH {CONTACTS} SELECT operator, count(*) * CASE WHEN operator % 3 = 0 AND (SELECT max(qso_at) FROM contacts) <> (SELECT max(qso_at) FROM contacts WHERE operator % 3 = 0) THEN 2 ELSE 1 END AS n FROM contacts
WHERE operator % 3 = 0 OR (SELECT max(qso_at) FROM contacts) <> (SELECT max(qso_at) FROM contacts WHERE operator % 3 = 0) GROUP BY operator"""
