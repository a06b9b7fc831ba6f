"""Activity reports over the contact log.

The log is the ``events`` table: ``event_id`` is the contact's id, ``ts`` its time, ``user_id`` the
operator, ``event_type`` the mode and ``k % 5`` of the JSON column ``props`` the band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.operators import stats
from radiolake.plans.tables import table

QUERIES, SQL = {}, {}


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("uuid"),
        F.col("ts").alias("qso_at"),
        F.col("user_id").alias("operator"),
        F.col("event_type").alias("mode"),
        (F.get_json_object("props", "$.k").cast("int") % 5).cast("string").alias("band"),
    )


#: The same view in the SQL that the queries are compared with.
CONTACTS = """contacts AS (SELECT event_id AS uuid, ts AS qso_at, user_id AS operator, event_type AS mode,
  CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS band FROM events)"""


def operator_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.operator_report(contacts(spark, sf_dir))


QUERIES["operator_report"] = operator_report
SQL["operator_report"] = f"""WITH {CONTACTS},
hours AS (SELECT operator, count(*) OVER (PARTITION BY operator ORDER BY qso_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM contacts),
peak AS (SELECT operator, max(n) AS best_hour, count(*) AS total FROM hours GROUP BY operator),
bands AS (SELECT operator, band, count(*) AS n, min((qso_at, uuid)) AS seen FROM contacts GROUP BY operator, band),
modes AS (SELECT operator, mode, count(*) AS n, min((qso_at, uuid)) AS seen FROM contacts GROUP BY operator, mode),
topb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY n DESC, seen) AS r FROM bands) WHERE r = 1),
topm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY n DESC, seen) AS r FROM modes) WHERE r = 1)
SELECT p.operator, p.total, p.best_hour, b.band AS top_band, CAST(floor(b.n * 100.0 / p.total + 0.5) AS BIGINT) AS top_band_pct,
  m.mode AS top_mode, CAST(floor(m.n * 100.0 / p.total + 0.5) AS BIGINT) AS top_mode_pct
FROM peak p JOIN topb b USING (operator) JOIN topm m USING (operator)"""


QUERIES["sliding_hour_max"] = lambda spark, sf_dir: stats.sliding_hour(contacts(spark, sf_dir))
SQL["sliding_hour_max"] = f"""WITH {CONTACTS}, h AS (SELECT operator, count(*) OVER (PARTITION BY operator ORDER BY qso_at
  RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM contacts) SELECT operator, max(n) AS best_hour FROM h GROUP BY operator"""

QUERIES["longest_gap"] = lambda spark, sf_dir: stats.longest_gap(contacts(spark, sf_dir))
SQL["longest_gap"] = f"""WITH {CONTACTS}, m AS (SELECT epoch_us(qso_at) // 1000 AS ms FROM contacts),
g AS (SELECT max(gap) AS gap_ms FROM (SELECT ms - lag(ms) OVER (ORDER BY ms) AS gap FROM m)),
r AS (SELECT gap_ms, CAST(floor(gap_ms / 60000 + 0.5) AS BIGINT) AS m FROM g)
SELECT gap_ms, coalesce((m // 60) || 'h ' || (m % 60) || 'm', '-') AS label FROM r"""

QUERIES["band_mode_cube"] = lambda spark, sf_dir: stats.band_mode_cube(contacts(spark, sf_dir))
SQL["band_mode_cube"] = f"""WITH {CONTACTS} SELECT CASE WHEN grouping(band) = 1 THEN '*' ELSE band END AS band,
  CASE WHEN grouping(mode) = 1 THEN '*' ELSE mode END AS mode, count(*) AS n FROM contacts GROUP BY CUBE (band, mode)"""

MODES = ["click", "error", "purchase", "signup", "view"]
QUERIES["band_mode_pivot"] = lambda spark, sf_dir: stats.band_mode_pivot(contacts(spark, sf_dir), MODES)
SQL["band_mode_pivot"] = f"WITH {CONTACTS} SELECT band, " + ", ".join(f"count(*) FILTER (WHERE mode = '{m}') AS {m}" for m in MODES) + " FROM contacts GROUP BY band"

QUERIES["rate_histogram"] = lambda spark, sf_dir: stats.histogram(contacts(spark, sf_dir), 21_600)
SQL["rate_histogram"] = f"""WITH {CONTACTS}, c AS (SELECT CAST(floor(epoch(qso_at) / 21600) AS BIGINT) AS bin, count(*) AS n FROM contacts GROUP BY 1),
b AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM c)
SELECT b.bin * 21600 AS bin_start, coalesce(n, 0) AS n, CAST(floor(coalesce(n, 0) * (3600.0 / 21600) + 0.5) AS BIGINT) AS rate FROM b LEFT JOIN c USING (bin)"""

QUERIES["median_outliers"] = lambda spark, sf_dir: stats.without_outliers(contacts(spark, sf_dir), 10)
SQL["median_outliers"] = f"""WITH {CONTACTS}, m AS (SELECT epoch_us(qso_at) // 1000 AS ms, row_number() OVER (ORDER BY qso_at) - 1 AS r, count(*) OVER () AS n FROM contacts),
k AS (SELECT ms AS median_ms FROM m WHERE r = n // 2)
SELECT median_ms, count(*) AS kept, min(ms) AS first_ms, max(ms) AS last_ms FROM m, k WHERE abs(ms - median_ms) <= 864000000 GROUP BY median_ms"""


def tally_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every seventh contact has no mode, as a log that was typed in has
    blank = contacts(spark, sf_dir).withColumn("mode", F.when(F.col("uuid") % 7 == 0, F.lit(" ")).otherwise(F.col("mode")))
    return stats.tally(blank, "mode")


QUERIES["tally_unknown"] = tally_unknown
SQL["tally_unknown"] = f"""WITH {CONTACTS}, c AS (SELECT CASE WHEN uuid % 7 = 0 THEN 'Unknown' ELSE mode END AS name, count(*) AS n, min((qso_at, uuid)) AS seen FROM contacts GROUP BY 1)
SELECT name, n, row_number() OVER (ORDER BY n DESC, seen) AS place FROM c"""

QUERIES["kpi_trailing"] = lambda spark, sf_dir: stats.kpis(contacts(spark, sf_dir))
SQL["kpi_trailing"] = f"""WITH {CONTACTS}, w AS (SELECT max(qso_at) AS now, min(qso_at) AS first, count(*) AS total, count(DISTINCT operator) AS operators FROM contacts)
SELECT total, operators, (SELECT count(*) FROM contacts WHERE qso_at >= now - INTERVAL 60 MINUTES) AS last_hour,
  4 * (SELECT count(*) FROM contacts WHERE qso_at >= now - INTERVAL 15 MINUTES) AS quarter_rate,
  CAST(floor(total / ((epoch_us(now) - epoch_us(first)) / 3.6e9) + 0.5) AS BIGINT) AS average_rate FROM w"""


def _worked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9900 OR c_mktsegment = 'NONE'")
    return rich.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")


QUERIES["missing_sections"] = lambda spark, sf_dir: stats.missing(table(spark, sf_dir, "nation"), _worked(spark, sf_dir), "n_name").select("n_name")
SQL["missing_sections"] = "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"

QUERIES["top_sections"] = lambda spark, sf_dir: stats.worked_top(
    table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), "n_name"
)
SQL["top_sections"] = "SELECT upper(n_name) AS section, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, section LIMIT 10"

QUERIES["value_breakdown"] = lambda spark, sf_dir: stats.breakdown(table(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_orderkey") % 11 == 0, F.lit("")).otherwise(F.col("o_orderpriority"))), "v")
SQL["value_breakdown"] = "SELECT CASE WHEN o_orderkey % 11 = 0 THEN '(none)' ELSE o_orderpriority END AS value, count(*) AS n FROM orders GROUP BY 1"
