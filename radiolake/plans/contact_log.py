"""The contact log's own operations over ``events`` and ``conversations``.

A change's id is ``user_id``, its edit time the hour of ``ts`` (so that ties are common), its arrival ``event_id``; every
ninth change is a tombstone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.operators import log, stats
from radiolake.plans.activity import CONTACTS, contacts
from radiolake.plans.tables import table

QUERIES, SQL = {}, {}


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("uuid"),
        F.col("ts").alias("created_at"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("last_edited"),
        F.col("event_id").alias("arrival_seq"),
        F.col("event_type").alias("mode"),
        (F.col("event_id") % 9 == 0).alias("deleted"),
    )


CHANGES = """changes AS (SELECT user_id AS uuid, ts AS created_at, date_trunc('hour', ts) AS last_edited, event_id AS arrival_seq, event_type AS mode,
  event_id % 9 = 0 AS deleted FROM events)"""
FOLD = """f AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY last_edited DESC, arrival_seq DESC) AS r,
  first_value(created_at) OVER (PARTITION BY uuid ORDER BY arrival_seq) AS born FROM changes)"""
_ms = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1000).cast("long").alias(f"{c}_ms")

QUERIES["lww_fold"] = lambda spark, sf_dir: log.fold(changes(spark, sf_dir)).select("uuid", _ms("created_at"), _ms("last_edited"), "arrival_seq", "mode", "deleted")
SQL["lww_fold"] = f"""WITH {CHANGES}, {FOLD} SELECT uuid, epoch_us(born) // 1000 AS created_at_ms, epoch_us(last_edited) // 1000 AS last_edited_ms, arrival_seq, mode, deleted FROM f WHERE r = 1"""

QUERIES["tombstone_filter"] = lambda spark, sf_dir: log.active(log.fold(changes(spark, sf_dir))).select("uuid", "arrival_seq", "mode")
SQL["tombstone_filter"] = f"WITH {CHANGES}, {FOLD} SELECT uuid, arrival_seq, mode FROM f WHERE r = 1 AND NOT deleted"

QUERIES["stored_flag"] = lambda spark, sf_dir: log.stored(changes(spark, sf_dir)).select("uuid", "arrival_seq", "stored")
SQL["stored_flag"] = f"""WITH {CHANGES} SELECT uuid, arrival_seq, coalesce(last_edited >= max(last_edited) OVER (PARTITION BY uuid ORDER BY arrival_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS stored FROM changes"""


def pull_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("synced_at"))
    cursor = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    return rows.where(F.col("synced_at") >= cursor).select("event_id", _ms("synced_at"))


QUERIES["pull_since"] = pull_since
SQL["pull_since"] = "SELECT event_id, epoch_us(ts) // 1000 AS synced_at_ms FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'"

QUERIES["chat_dedupe"] = lambda spark, sf_dir: log.first_arrivals(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.length("text").cast("long").alias("n_chars")), ["conv_id", "role"], "turn")
SQL["chat_dedupe"] = """SELECT conv_id, role, turn, n_chars FROM (SELECT conv_id, role, turn, length(text) AS n_chars,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r = 1"""

QUERIES["chat_reconcile"] = lambda spark, sf_dir: log.reconcile(
    table(spark, sf_dir, "conversations").select("conv_id", "role").distinct().withColumn("uuid", F.concat_ws(":", "conv_id", "role")).select("uuid"),
    table(spark, sf_dir, "conversations").where("turn = 0 OR role = 'user'").select(F.concat_ws(":", "conv_id", "role").alias("uuid")).distinct(),
    "uuid",
)
SQL["chat_reconcile"] = """WITH l AS (SELECT DISTINCT conv_id || ':' || role AS uuid FROM conversations),
s AS (SELECT DISTINCT conv_id || ':' || role AS uuid FROM conversations WHERE turn = 0 OR role = 'user')
SELECT uuid, 'confirmed' AS state FROM s UNION ALL SELECT uuid, 'failed' FROM l WHERE uuid NOT IN (SELECT uuid FROM s)"""


def accumulate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    side = lambda cond: events.where(cond).groupBy(F.col("user_id").alias("call")).agg(
        F.max(F.when(F.col("event_type") == "view", F.year("ts"))).alias("fd_last_year"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("value").cast("long"))).alias("hunter"),
        F.max(F.when(F.col("event_type") == "signup", F.lit(1))).alias("scp"),
        F.min(F.to_date("ts").cast("string")).alias("first_seen"),
        F.max(F.to_date("ts").cast("string")).alias("last_seen"),
    )
    merged = log.accumulate(side("event_id % 3 = 0"), side("event_id % 3 <> 0"), "call")
    return log.source_count(merged, ["fd_last_year", "hunter", "scp"])


QUERIES["accumulate_merge"] = accumulate_merge
SQL["accumulate_merge"] = """WITH m AS (SELECT user_id AS call, CAST(max(year(ts)) FILTER (WHERE event_type = 'view') AS INTEGER) AS fd_last_year,
  max(CAST(trunc(value) AS BIGINT)) FILTER (WHERE event_type = 'purchase') AS hunter, CAST(max(1) FILTER (WHERE event_type = 'signup') AS INTEGER) AS scp,
  min(CAST(CAST(ts AS DATE) AS VARCHAR)) AS first_seen, max(CAST(CAST(ts AS DATE) AS VARCHAR)) AS last_seen
  FROM events GROUP BY user_id)
SELECT *, CAST((fd_last_year IS NOT NULL)::INT + (hunter IS NOT NULL)::INT + (scp IS NOT NULL)::INT AS INTEGER) AS source_count FROM m"""


#: Contacts as a log that was typed in has them: some without a call, band, mode or time.
_TYPED_COLUMNS = {
    "uuid": "uuid", "remote_callsign": "CASE WHEN uuid % 31 <> 0 THEN concat('K', operator % 40) END", "band": "CASE WHEN uuid % 17 <> 0 THEN band END",
    "mode": "CASE WHEN uuid % 19 <> 0 THEN mode END", "qso_at": "CASE WHEN uuid % 23 <> 0 THEN qso_at END", "operator": "CASE WHEN operator % 29 <> 3 THEN operator END",
}
_TYPED = ", ".join(f"{e} AS {n}" for n, e in _TYPED_COLUMNS.items())


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(spark, sf_dir).select(*[F.expr(e).alias(n) for n, e in _TYPED_COLUMNS.items()])


for _kind, _name, _keys in (("any", "dupe_any", ""), ("band-mode", "dupe_band_mode", ", band, mode"), ("band-mode-day", "dupe_band_mode_day", ", band, mode, CAST(qso_at AS DATE)")):
    QUERIES[_name] = lambda spark, sf_dir, kind=_kind: log.duplicates(typed(spark, sf_dir), kind).select("uuid", "remote_callsign", "previous")
    SQL[_name] = f"WITH {CONTACTS}, t AS (SELECT {_TYPED} FROM contacts) SELECT uuid, remote_callsign, lag(uuid) OVER (PARTITION BY remote_callsign{_keys} ORDER BY qso_at NULLS LAST, uuid) AS previous FROM t"

QUERIES["typed_operator_report"] = lambda spark, sf_dir: stats.operator_report(typed(spark, sf_dir))
SQL["typed_operator_report"] = f"""WITH {CONTACTS}, t AS (SELECT {_TYPED} FROM contacts),
hours AS (SELECT operator, count(*) OVER (PARTITION BY operator ORDER BY qso_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM t WHERE qso_at IS NOT NULL),
peak AS (SELECT operator, max(n) AS best FROM hours GROUP BY operator), total AS (SELECT operator, count(*) AS total FROM t GROUP BY operator),
bands AS (SELECT operator, band, count(*) AS n, row_number() OVER (PARTITION BY operator ORDER BY count(*) DESC, bool_or(qso_at IS NULL) DESC, min(CASE WHEN qso_at IS NULL THEN uuid END), min(qso_at), arg_min(uuid, (qso_at, uuid))) AS r FROM t GROUP BY operator, band),
modes AS (SELECT operator, mode, count(*) AS n, row_number() OVER (PARTITION BY operator ORDER BY count(*) DESC, bool_or(qso_at IS NULL) DESC, min(CASE WHEN qso_at IS NULL THEN uuid END), min(qso_at), arg_min(uuid, (qso_at, uuid))) AS r FROM t GROUP BY operator, mode)
SELECT p.operator, p.total, coalesce(k.best, 0) AS best_hour, b.band AS top_band, CAST(floor(b.n * 100.0 / p.total + 0.5) AS BIGINT) AS top_band_pct, m.mode AS top_mode, CAST(floor(m.n * 100.0 / p.total + 0.5) AS BIGINT) AS top_mode_pct
FROM total p LEFT JOIN peak k ON p.operator IS NOT DISTINCT FROM k.operator JOIN bands b ON p.operator IS NOT DISTINCT FROM b.operator AND b.r = 1 JOIN modes m ON p.operator IS NOT DISTINCT FROM m.operator AND m.r = 1"""


def import_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = typed(spark, sf_dir).withColumn("qso_at", F.date_trunc("hour", "qso_at"))
    return log.import_new(hourly.where("uuid % 4 <> 0"), hourly.where("uuid % 4 = 0"), "uuid").select("uuid", "remote_callsign", "band", "mode")


QUERIES["import_dedupe"] = import_dedupe
SQL["import_dedupe"] = f"""WITH {CONTACTS}, t AS (SELECT {_TYPED} FROM contacts), h AS (SELECT uuid, remote_callsign, band, mode, date_trunc('hour', qso_at) AS t FROM t),
i AS (SELECT *, row_number() OVER (PARTITION BY remote_callsign, band, mode, t ORDER BY uuid) AS r FROM h WHERE uuid % 4 <> 0)
SELECT uuid, remote_callsign, band, mode FROM i WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.uuid % 4 = 0 AND h.remote_callsign IS NOT DISTINCT FROM i.remote_callsign
  AND h.band IS NOT DISTINCT FROM i.band AND h.mode IS NOT DISTINCT FROM i.mode AND h.t IS NOT DISTINCT FROM i.t)"""


def contact_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that are white space only, and calls and zones with white space around them."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uuid"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("\t\u00a0 ")).otherwise(F.concat(F.lit("\u2003K"), F.col("o_custkey").cast("string"), F.lit("\n"))).alias("call"),
        F.concat(F.lit(" "), (F.col("o_custkey") % 60).cast("string"), F.lit("\t")).alias("cq_zone"),
    )
    return log.validate(rows, ["call"], {"call": "K[0-9]{1,3}", "cq_zone": "[1-9]|[1-3][0-9]|40"}).select("uuid", "errors")


QUERIES["contact_errors"] = contact_errors
SQL["contact_errors"] = """WITH r AS (SELECT o_orderkey AS uuid, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'K' || o_custkey END AS call, CAST(o_custkey % 60 AS VARCHAR) AS z FROM orders)
SELECT uuid, concat_ws('; ', CASE WHEN trim(call) = '' THEN 'call is required' END, CASE WHEN trim(call) <> '' AND NOT regexp_full_match(call, 'K[0-9]{1,3}') THEN 'call is not valid' END,
  CASE WHEN NOT regexp_full_match(z, '[1-9]|[1-3][0-9]|40') THEN 'cq_zone is not valid' END) AS errors FROM r"""


def _parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda m: F.concat(F.lit("US-"), (F.col("p_partkey") % m).cast("string"))
    listed = F.when(F.col("p_partkey") % 3 == 0, F.concat(part(17), F.lit(", "), part(23))).when(F.col("p_partkey") % 3 == 1, part(17)).otherwise(F.lit(" ,"))
    return table(spark, sf_dir, "part").select("p_partkey", listed.alias("parks"))


_PARKS = """p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'US-' || (p_partkey % 17) || ', US-' || (p_partkey % 23) WHEN 1 THEN 'US-' || (p_partkey % 17) ELSE ' ,' END AS parks FROM part)"""
QUERIES["park_explode"] = lambda spark, sf_dir: log.per_park(_parks(spark, sf_dir), "parks")
SQL["park_explode"] = f"""WITH {_PARKS}, e AS (SELECT p_partkey, list_filter(list_transform(string_split(parks, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM p)
SELECT p_partkey, unnest(CASE WHEN len(l) > 0 THEN l ELSE [''] END) AS parks FROM e"""
QUERIES["multi_membership"] = lambda spark, sf_dir: _parks(spark, sf_dir).where(log.has_member(F.regexp_replace("parks", " ", ""), "US-5")).select("p_partkey")
SQL["multi_membership"] = f"WITH {_PARKS} SELECT p_partkey FROM p WHERE ',' || replace(parks, ' ', '') || ',' LIKE '%,US-5,%'"
