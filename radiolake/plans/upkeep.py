"""Entry forms, stations, caches, indexes and region checks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import scalars
from radiolake.operators import etl, forms, spatial
from radiolake.plans.activity import CONTACTS, contacts
from radiolake.plans.places import POINTS, REGIONS, points, region_parts
from radiolake.plans.tables import table

QUERIES, SQL = {}, {}


def entry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE ' ' END")
    remembered = F.expr("CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END")
    looked_up = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS STRING) END")
    return table(spark, sf_dir, "orders").select("o_orderkey", *forms.merged_entry({"name": [typed, remembered, looked_up], "comment": [remembered, F.lit("none")]}))


QUERIES["entry_merge"] = entry_merge
SQL["entry_merge"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 4 = 0 THEN o_orderstatus WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS name,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE 'none' END AS comment FROM orders"""


def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumns({"section": F.expr("CASE c_custkey % 3 WHEN 0 THEN 'EMA' WHEN 1 THEN '' END"), "state": F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'OR' ELSE 'CA' END")})
    section, state = forms.cross_fill(F.col("section"), F.col("state"), {"EMA": "MA"}, {"OR": "OR"})
    return rows.select("c_custkey", section.alias("section"), state.alias("state"))


QUERIES["section_fill"] = section_fill
SQL["section_fill"] = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'EMA' WHEN c_custkey % 2 = 0 THEN 'OR' WHEN c_custkey % 3 = 1 THEN '' END AS section,
  CASE WHEN c_custkey % 3 = 0 THEN 'MA' WHEN c_custkey % 2 = 0 THEN 'OR' ELSE 'CA' END AS state FROM customer"""

QUERIES["band_conflicts"] = lambda spark, sf_dir: forms.band_conflicts(contacts(spark, sf_dir).select(F.col("operator").alias("client"), "band", F.col("qso_at").alias("at")), 36_000)
SQL["band_conflicts"] = f"""WITH {CONTACTS} SELECT band, count(DISTINCT operator) AS clients FROM contacts WHERE qso_at >= (SELECT max(qso_at) FROM contacts) - INTERVAL 36000 SECOND GROUP BY band HAVING count(DISTINCT operator) > 1"""
QUERIES["age_buckets"] = lambda spark, sf_dir: contacts(spark, sf_dir).groupBy(forms.age_bucket(F.second("qso_at") + F.lit(10)).alias("age")).agg(F.count("*").alias("n"))
SQL["age_buckets"] = f"WITH {CONTACTS} SELECT CASE WHEN second(qso_at) + 10 < 15 THEN 'fresh' WHEN second(qso_at) + 10 <= 60 THEN 'stale' ELSE 'old' END AS age, count(*) AS n FROM contacts GROUP BY 1"

_STATUS = "CASE WHEN event_type IN ('click', 'view') THEN 'ok' WHEN event_type = 'signup' THEN 'not_found' WHEN event_type = 'never' THEN 'error' ELSE 'ok' END"
QUERIES["cache_stats"] = lambda spark, sf_dir: forms.status_counts(table(spark, sf_dir, "events").select(F.expr(_STATUS).alias("status")))
SQL["cache_stats"] = f"WITH s AS (SELECT {_STATUS} AS status FROM events) SELECT k.status, count(s.status) AS n FROM (VALUES ('ok'), ('not_found'), ('error')) k(status) LEFT JOIN s USING (status) GROUP BY k.status"


def cache_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'not_found' ELSE 'error' END")
    rows = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("fetched"), status.alias("status"))
    return rows.select("event_id", scalars.expires(F.col("fetched"), F.col("status")).alias("expires_ms")).where(F.col("expires_ms") > 1_707_000_000_000)


QUERIES["cache_valid"] = cache_valid
SQL["cache_valid"] = """WITH e AS (SELECT event_id, epoch_us(ts) // 1000 + CASE event_type WHEN 'click' THEN 31536000000 WHEN 'view' THEN 2592000000 ELSE 900000 END AS expires_ms FROM events)
SELECT event_id, expires_ms FROM e WHERE expires_ms > 1707000000000"""

_FIXES = [(3, "CANADA", "Canada"), (4, "EGYPT", "EGYPT"), (7, "x", "y")]
QUERIES["corrections"] = lambda spark, sf_dir: forms.corrected(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name", _FIXES)
SQL["corrections"] = "SELECT n_nationkey, " + "CASE " + " ".join(f"WHEN n_nationkey = {k} AND n_name = '{o}' THEN '{n}'" for k, o, n in _FIXES) + " ELSE n_name END AS n_name, CASE " + " ".join(f"WHEN n_nationkey = {k} THEN CASE WHEN n_name = '{o}' THEN 'applied' WHEN n_name = '{n}' THEN 'already' ELSE 'stale' END" for k, o, n in _FIXES) + " END AS state FROM nation"


def call_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda t, k, v: table(spark, sf_dir, t).select((F.col(k) % 900).alias("call"), v.cast("long").alias("value"))
    return forms.call_index({
        "fd": pair("customer", "c_custkey", F.col("c_nationkey")),
        "pota": pair("orders", "o_custkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey"))),
        "scp": pair("supplier", "s_suppkey", F.lit(None)),
    })


QUERIES["call_index"] = call_index
SQL["call_index"] = """WITH a AS (SELECT c_custkey % 900 AS call, CAST(max(c_nationkey) AS BIGINT) AS fd FROM customer GROUP BY 1), b AS (SELECT o_custkey % 900 AS call, max(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END) AS pota FROM orders GROUP BY 1),
c AS (SELECT DISTINCT s_suppkey % 900 AS call FROM supplier)
SELECT call, fd, pota, CAST(NULL AS BIGINT) AS scp, CAST((a.call IS NOT NULL)::INT + (b.call IS NOT NULL)::INT + (c.call IS NOT NULL)::INT AS INTEGER) AS source_count FROM a FULL JOIN b USING (call) FULL JOIN c USING (call)"""

QUERIES["import_report"] = lambda spark, sf_dir: forms.import_report(table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE o_orderstatus END").alias("call"), F.expr("CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END").alias("band")), ["call", "band"])
SQL["import_report"] = """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey % 6 = 0 OR o_orderkey % 10 = 0) AS bad, count(*) FILTER (WHERE o_orderkey % 6 = 0) AS missing_call, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS missing_band FROM orders"""


def pick_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's lines the first long one that is returned, else the first long one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag"))).alias("c"))
    best = etl.pick(F.col("c"), lambda c: c["l_quantity"] > 25, lambda c: c["l_returnflag"] == "R")
    return lines.select("l_orderkey", best["l_partkey"].alias("l_partkey"), best["l_linenumber"].alias("l_linenumber"))


QUERIES["pick_candidates"] = pick_candidates
SQL["pick_candidates"] = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_linenumber, l_partkey, l_quantity, l_returnflag) AS r FROM lineitem WHERE l_quantity > 25)
SELECT o.l_orderkey, r.l_partkey, r.l_linenumber FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN r ON o.l_orderkey = r.l_orderkey AND r.r = 1"""

def _county_parts(spark: SparkSession) -> DataFrame:
    return region_parts(spark).select((F.col("feature") % 2).alias("state"), F.concat(F.lit("c"), F.col("part").cast("string")).alias("county"), F.col("part").alias("position"), "rings")


QUERIES["county_snap"] = lambda spark, sf_dir: spatial.county_of(points(spark, sf_dir).withColumn("state", (F.col("c_custkey") % 2).cast("int")), _county_parts(spark), "c_custkey", "state", "county", "position", 4.0)
_EDGES = ", ".join(f"({f % 2}, {p}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for f, p, rings in REGIONS for r in rings for a, b in zip(r, r[1:], strict=False))
SQL["county_snap"] = f"""WITH {POINTS}, e(state, part, y1, x1, y2, x2) AS (VALUES {_EDGES}),
j AS (SELECT c_custkey, part, lat, lon, y1, x1, y2, x2, greatest(0.0, least(1.0, ((lat - y1) * (y2 - y1) + (lon - x1) * (x2 - x1)) / ((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1)))) AS t FROM pts JOIN e ON e.state = c_custkey % 2),
d AS (SELECT c_custkey, part, count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside,
  min(sqrt((y1 + t * (y2 - y1) - lat) * (y1 + t * (y2 - y1) - lat) + (x1 + t * (x2 - x1) - lon) * (x1 + t * (x2 - x1) - lon))) AS d FROM j GROUP BY c_custkey, part),
b AS (SELECT c_custkey, arg_min('c' || part, (CASE WHEN inside THEN 0.0 ELSE d END, CASE WHEN inside THEN -part ELSE part END)) AS county FROM d WHERE inside OR d <= 4.0 GROUP BY c_custkey)
SELECT p.c_custkey, county FROM pts p LEFT JOIN b USING (c_custkey)"""


def county_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All divisions, however far; points that only stand for their whole province are left out."""
    placed = points(spark, sf_dir).where("c_custkey % 9 <> 0")
    parts = _county_parts(spark).where("position > 0")
    return spatial.nearest_part(placed, parts, "c_custkey", "county", "position")


QUERIES["county_nearest"] = county_nearest
SQL["county_nearest"] = SQL["county_snap"].replace("ON e.state = c_custkey % 2", "ON e.part > 0").replace("WHERE inside OR d <= 4.0 ", "").replace("FROM pts p LEFT JOIN b USING (c_custkey)", "FROM pts p LEFT JOIN b USING (c_custkey) WHERE c_custkey % 9 <> 0")


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around customers' points whose areas meet."""
    boxes = points(spark, sf_dir).select("c_custkey", (F.col("lon") - 1.5).alias("minx"), (F.col("lon") + 1.5).alias("maxx"), (F.col("lat") - 0.5).alias("miny"), (F.col("lat") + 0.5).alias("maxy"))
    return spatial.overlaps(boxes, "c_custkey")


QUERIES["box_overlaps"] = box_overlaps
SQL["box_overlaps"] = f"""WITH {POINTS} SELECT a.c_custkey, b.c_custkey AS c_custkey2, (3.0 - abs(a.lon - b.lon)) * (1.0 - abs(a.lat - b.lat)) AS area FROM pts a JOIN pts b
ON a.c_custkey < b.c_custkey AND abs(a.lon - b.lon) < 3 AND abs(a.lat - b.lat) < 1"""

QUERIES["sliding_counts"] = lambda spark, sf_dir: table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "60 minutes", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "n")
SQL["sliding_counts"] = """SELECT (CAST(floor(epoch(ts) / 900) AS BIGINT) - k) * 900 AS start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1"""
