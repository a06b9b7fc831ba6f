"""Table building, exports and checks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.operators import etl
from radiolake.plans.activity import CONTACTS, contacts
from radiolake.plans.places import POINTS, points
from radiolake.plans.tables import table
from radiolake.sources import adif

QUERIES, SQL = {}, {}


def dump_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    entities = orders.select(F.col("o_orderkey").alias("usi"), F.col("o_custkey").alias("owner"))
    headers = orders.select(F.col("o_orderkey").alias("usi"), F.when(F.col("o_orderstatus") == "O", "A").otherwise("E").alias("status"), F.col("o_orderpriority").alias("service"))
    extras = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("usi"), F.col("l_linenumber").alias("position")).agg(F.max("l_partkey").alias("class"))
    return etl.merge_dumps(entities, headers, extras, "usi", "position")


QUERIES["fcc_merge"] = dump_merge
SQL["fcc_merge"] = """WITH x AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS class FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
a AS (SELECT l_orderkey, arg_max(class, l_linenumber) AS class FROM x GROUP BY l_orderkey)
SELECT o_orderkey AS usi, o_custkey AS owner, o_orderpriority AS service, class FROM orders LEFT JOIN a ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'"""

_ROWS = "o_custkey AS licensee, concat_ws('|', 'STREET ' || CAST(o_custkey % 700 AS {s}), CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'TOWN' END) AS address"
_CACHE = "concat_ws('|', 'STREET ' || CAST(p_partkey % 800 AS {s}), CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'TOWN' END) AS address, p_size > 20 AS matched, p_size AS fetched_at, CAST(p_partkey AS {s}) AS coordinates"


def _addresses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    town = lambda k: F.when(F.col(k) % 4 != 0, F.lit(" town"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("licensee"), etl.address_key(F.concat(F.lit("Street "), (F.col("o_custkey") % 700).cast("string")), town("o_custkey")).alias("address"))
    cache = table(spark, sf_dir, "part").select(etl.address_key(F.concat(F.lit("street "), (F.col("p_partkey") % 800).cast("string")), town("p_partkey")).alias("address"), (F.col("p_size") > 20).alias("matched"), F.col("p_size").alias("fetched_at"), F.col("p_partkey").cast("string").alias("coordinates"))
    return rows, cache


QUERIES["geocode_join"] = lambda spark, sf_dir: etl.with_coordinates(*_addresses(spark, sf_dir), "address")
SQL["geocode_join"] = f"""WITH r AS (SELECT {_ROWS.format(s="VARCHAR")} FROM orders), c AS (SELECT {_CACHE.format(s="VARCHAR")} FROM part)
SELECT address, licensee, coordinates FROM r LEFT JOIN (SELECT address, arg_max(coordinates, (fetched_at, coordinates)) AS coordinates FROM c WHERE matched GROUP BY address) USING (address)"""
QUERIES["cache_counts"] = lambda spark, sf_dir: etl.cache_counts(*_addresses(spark, sf_dir), "address", 10)
SQL["cache_counts"] = f"""WITH r AS (SELECT DISTINCT address FROM (SELECT {_ROWS.format(s="VARCHAR")} FROM orders)), c AS (SELECT address, bool_or(matched) AS hit, bool_or(fetched_at >= 10) AS fresh FROM (SELECT {_CACHE.format(s="VARCHAR")} FROM part) GROUP BY address)
SELECT count(*) FILTER (WHERE coalesce(hit, false)) AS hits, count(*) FILTER (WHERE NOT coalesce(hit, false) AND coalesce(fresh, false)) AS fresh_misses, count(*) FILTER (WHERE NOT coalesce(hit, false) AND NOT coalesce(fresh, false)) AS to_do FROM r LEFT JOIN c USING (address)"""
QUERIES["cache_diff"] = lambda spark, sf_dir: etl.to_geocode(*_addresses(spark, sf_dir), "address", 10)
SQL["cache_diff"] = f"""WITH r AS (SELECT {_ROWS.format(s="VARCHAR")} FROM orders), c AS (SELECT {_CACHE.format(s="VARCHAR")} FROM part)
SELECT DISTINCT address FROM r WHERE address NOT IN (SELECT address FROM c WHERE matched OR fetched_at >= 10)"""

QUERIES["repeated_keys"] = lambda spark, sf_dir: etl.repeated_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")
SQL["repeated_keys"] = "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"
_NAMES = lambda spark, sf_dir, t, c: table(spark, sf_dir, t).select((F.col(c) % 130).alias("name"))
QUERIES["drift_report"] = lambda spark, sf_dir: etl.drift(_NAMES(spark, sf_dir, "supplier", "s_suppkey"), _NAMES(spark, sf_dir, "customer", "c_custkey").where("name > 50"), "name")
SQL["drift_report"] = """WITH a AS (SELECT DISTINCT s_suppkey % 130 AS name FROM supplier), b AS (SELECT DISTINCT c_custkey % 130 AS name FROM customer WHERE c_custkey % 130 > 50)
SELECT name, 'left' AS only_in FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'right' FROM b WHERE name NOT IN (SELECT name FROM a)"""
QUERIES["missing_numbers"] = lambda spark, sf_dir: etl.missing_numbers(table(spark, sf_dir, "nation").where("n_regionkey <> 2"), "n_nationkey", 40)
SQL["missing_numbers"] = "SELECT n_nationkey FROM (SELECT unnest(range(1, 41)) AS n_nationkey) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)"
QUERIES["integrity_check"] = lambda spark, sf_dir: etl.orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2 + 20).alias("k")), "k")
SQL["integrity_check"] = """WITH o AS (SELECT o_custkey * 2 + 20 AS k FROM orders)
SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM o)) AS without_children, (SELECT count(*) FROM o WHERE k NOT IN (SELECT c_custkey FROM customer)) AS without_parent"""


def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select(
        F.concat_ws("-", (F.col("c_nationkey") % 9).cast("string"), F.col("c_custkey").cast("string")).alias("reference"),
        F.expr("CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 0.0D WHEN c_custkey % 90 = 1 THEN 92.0D ELSE lat END").alias("latitude"),
        F.expr("CASE WHEN c_custkey % 7 = 0 THEN 0.0D ELSE lon END").alias("longitude"),
    )
    return etl.quality_counters(rows, "reference", "latitude", "longitude")


QUERIES["quality_counters"] = quality_counters
SQL["quality_counters"] = f"""WITH {POINTS}, r AS (SELECT c_nationkey % 9 AS p, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 0.0 WHEN c_custkey % 90 = 1 THEN 92.0 ELSE lat END AS y,
  CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE lon END AS x FROM pts)
SELECT count(*) AS total, count(DISTINCT p) AS prefixes, count(*) FILTER (WHERE y IS NULL OR x IS NULL) AS missing, count(*) FILTER (WHERE y = 0 AND x = 0) AS placeholders,
  count(*) FILTER (WHERE NOT y BETWEEN -90 AND 90 OR NOT x BETWEEN -180 AND 180) AS impossible FROM r"""

_SPELLED = "CASE doc_id % 3 WHEN 0 THEN 'Quebec' WHEN 1 THEN 'Québec' ELSE 'Québéc' END"
QUERIES["best_spelling"] = lambda spark, sf_dir: etl.best_spelling(table(spark, sf_dir, "documents").select("source", F.expr(_SPELLED).alias("town"), "doc_id"), "source", "town", "doc_id")
SQL["best_spelling"] = f"SELECT source, arg_max(town, (strlen(town) - length(town), -doc_id)) AS town FROM (SELECT source, doc_id, {_SPELLED} AS town FROM documents) GROUP BY source"


def adif_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    comment = F.when(F.col("uuid") % 5 == 0, F.lit("ß é"))
    fields = [("CALL", F.concat(F.lit("K"), F.col("operator").cast("string"))), ("QSO_DATE", F.lit("")), ("BAND", F.concat("band", F.lit("m"))), ("MODE", F.upper("mode")), ("COMMENT", comment)]
    return contacts(spark, sf_dir).select("uuid", adif.line(fields, F.col("qso_at")).alias("record"))


QUERIES["adif_text"] = adif_text
SQL["adif_text"] = f"""WITH {CONTACTS} SELECT uuid, '<CALL:' || length('K' || operator) || '>K' || operator || ' <QSO_DATE:8>' || strftime(qso_at, '%Y%m%d') || ' <TIME_ON:6>' || strftime(qso_at, '%H%M%S')
  || ' <BAND:' || length(band || 'm') || '>' || band || 'm <MODE:' || length(mode) || '>' || upper(mode) || CASE WHEN uuid % 5 = 0 THEN ' <COMMENT:5>ß é' ELSE '' END || ' <EOR>' AS record FROM contacts"""
QUERIES["dupe_sheet"] = lambda spark, sf_dir: adif.dupe_sheet(contacts(spark, sf_dir).select(F.concat("band", F.lit("0m")).alias("band"), "mode", F.concat(F.lit("K"), F.col("operator").cast("string")).alias("call")), ["40m", "20m", "00m"])
SQL["dupe_sheet"] = f"""WITH {CONTACTS}, g AS (SELECT band, mode, 'K' || operator AS call, count(*) AS times FROM contacts GROUP BY ALL UNION ALL SELECT band, mode, '', count(*) FROM contacts GROUP BY ALL)
SELECT CAST(CASE band WHEN '4' THEN 1 WHEN '2' THEN 2 WHEN '0' THEN 3 ELSE 4 END AS INTEGER) AS band_rank, band || '0' AS band, mode, call, times FROM g"""


def adif_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written and parsed back: one text of each operator's records of a day."""
    lines = QUERIES["adif_text"](spark, sf_dir).join(contacts(spark, sf_dir).select("uuid", "operator", F.to_date("qso_at").alias("day")), "uuid")
    joined = F.array_join(F.array_sort(F.collect_list("record")), "\n")
    texts = lines.groupBy("operator", "day").agg(F.concat(F.lit("log <EOH>"), F.regexp_replace(joined, "<COMMENT:5>", "<COMMENT:3>")).alias("value"))
    parsed = adif.parse(texts)
    return parsed.select(F.col("fields")["CALL"].alias("call"), F.unix_millis(adif.timestamp(F.col("fields"))).alias("at_ms"), F.col("fields")["MODE"].alias("mode"), F.col("fields")["COMMENT"].alias("comment"))


QUERIES["adif_parse"] = adif_round_trip
SQL["adif_parse"] = f"""WITH {CONTACTS} SELECT 'K' || operator AS call, epoch_us(date_trunc('second', qso_at)) // 1000 AS at_ms, upper(mode) AS mode, CASE WHEN uuid % 5 = 0 THEN 'ß é' END AS comment FROM contacts"""
