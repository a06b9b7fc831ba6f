"""Log files written from the contacts, read back and imported into a log that has some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.operators import importing, log
from radiolake.plans.activity import CONTACTS, contacts
from radiolake.shared import staged
from radiolake.sources import adif

QUERIES, SQL = {}, {}

#: What the event requires, with the defaults, and how the files' bands and modes are named there.
_REQUIRED, _LABELS = {"state": "", "their_park": "NONE"}, {"state": "State"}
_MODES, _BANDS = {"CLICK": "CW", "view": "Phone"}, {"0M": "160m", "1m": "80m", "2m": "40m"}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each operator's contacts of a day: a header and records, some of which can't be used."""
    rows = contacts(spark, sf_dir)
    when = lambda every, value: F.when(F.col("uuid") % every != 0, value)
    fields = [
        ("CALL", when(29, F.concat(F.lit("k"), F.col("uuid").cast("string")))), ("QSO_DATE", F.lit("")), ("BAND", F.concat("band", F.lit("m"))), ("MODE", F.upper("mode")), ("OPERATOR", when(5, F.concat(F.lit("w "), F.col("operator").cast("string")))),
        ("STATE", when(11, F.lit("OR"))), ("GRID", F.lit("CN87")), ("COMMENT", F.lit("ß <b> 😀")), ("SIG", F.when(F.col("uuid") % 4 == 0, "pota")), ("SIG_INFO", F.concat(F.lit("US-"), "band")),
    ]
    # lengths count UTF-16 units: the comment has 8, in 13 bytes
    record = F.replace(adif.line(fields, F.col("qso_at")), F.lit("<COMMENT:11>"), F.lit("<COMMENT:8>"))
    cut = F.when(F.col("uuid") % 37 == 0, F.regexp_replace(record, "<TIME_ON:6>\\d{6}", "<TIME_ON:5>12345")).otherwise(record)
    texts = rows.select("operator", F.to_date("qso_at").alias("day"), F.struct("uuid", cut.alias("r")).alias("r")).groupBy("operator", "day").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return texts.select(F.concat(F.lit("log <PROGRAMID:4>test <EOH>\n"), F.array_join("rs.r", "\n")).alias("value"))


def _imported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # read once, as the tallies and the import both need the records
    records = staged(adif.parse(files(spark, sf_dir)))
    # calls are unique here, so they give the order of the records
    rows = importing.contacts(records, _REQUIRED, _MODES, _BANDS, (0, 1, -30), " w1aw ", "ab", True).withColumn("position", F.substring("remote_callsign", 2, 20).cast("long"))
    known = contacts(spark, sf_dir).where("uuid % 3 = 0").select(
        F.concat(F.lit("k"), F.col("uuid").cast("string")).alias("remote_callsign"), F.expr("CASE band WHEN '0' THEN '160m' WHEN '1' THEN '80m' WHEN '2' THEN '40m' ELSE 'Other' END").alias("band"),
        F.expr("CASE mode WHEN 'click' THEN 'CW' WHEN 'view' THEN 'Phone' ELSE 'Other' END").alias("mode"), (F.col("qso_at").cast("timestamp") + F.expr("INTERVAL 30 MINUTES")).alias("qso_at"),
    )
    return records, rows, log.import_new(rows, known, "position")


def import_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _imported(spark, sf_dir)[2]
    return new.select("remote_callsign", F.unix_millis("qso_at").alias("at_ms"), "band", "mode", "operator", "initials", "state", "gridsquare", "comment", F.col("fields")["their_park"].alias("their_park"))


QUERIES["import_flow"] = import_flow
_USABLE = "uuid % 29 <> 0 AND uuid % 37 <> 0"
SQL["import_flow"] = f"""WITH {CONTACTS} SELECT 'K' || uuid AS remote_callsign, epoch_us(date_trunc('second', qso_at)) // 1000 + 1800000 AS at_ms, CASE band WHEN '0' THEN '160m' WHEN '1' THEN '80m' WHEN '2' THEN '40m' ELSE 'Other' END AS band,
  CASE mode WHEN 'click' THEN 'CW' WHEN 'view' THEN 'Phone' ELSE 'Other' END AS mode, CASE WHEN uuid % 5 <> 0 THEN 'W' || operator ELSE 'W1AW' END AS operator, 'AB' AS initials, 'OR' AS state, 'CN87' AS gridsquare, 'ß <b> 😀' AS comment,
  CASE WHEN uuid % 4 = 0 THEN 'US-' || band ELSE 'NONE' END AS their_park FROM contacts WHERE {_USABLE} AND uuid % 11 <> 0 AND uuid % 3 <> 0"""

QUERIES["import_tallies"] = lambda spark, sf_dir: (lambda parts: importing.tallies(parts[0], _REQUIRED, _LABELS, parts[2]))(_imported(spark, sf_dir))
SQL["import_tallies"] = f"""WITH {CONTACTS} SELECT count(*) AS total, count(*) FILTER (WHERE NOT ({_USABLE})) AS bad, count(*) FILTER (WHERE {_USABLE} AND uuid % 11 = 0) AS unsyncable,
  CASE WHEN count(*) FILTER (WHERE {_USABLE} AND uuid % 11 = 0) > 0 THEN 'State' ELSE '' END AS unsyncable_fields, count(*) FILTER (WHERE {_USABLE} AND uuid % 5 = 0) AS missing_operator, count(*) FILTER (WHERE {_USABLE}) AS missing_initials,
  count(*) FILTER (WHERE {_USABLE} AND uuid % 11 <> 0 AND uuid % 3 = 0) AS dupes, count(*) FILTER (WHERE {_USABLE} AND uuid % 11 <> 0 AND uuid % 3 <> 0) AS imported FROM contacts"""


def adif_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's records: mapped bands and modes, built-in fields in order, custom fields, a park's two tags."""
    rows = contacts(spark, sf_dir).select(
        "uuid", "qso_at", F.concat(F.lit("K"), F.col("uuid").cast("string")).alias("remote_callsign"), "band", "mode", F.lit("W1AW").alias("station"), F.lit("N0X").alias("operator"), F.lit("ab").alias("initials"), F.lit(" é ").alias("name"),
        F.when(F.col("uuid") % 2 == 0, "OR").alias("state"), F.create_map(F.lit("class"), F.concat(F.lit("3"), "band"), F.lit("their_park"), F.when(F.col("uuid") % 4 == 0, F.concat(F.lit("US-"), "band")).otherwise(" "), F.lit("power"), F.lit("5")).alias("fields"),
    )
    line = adif.archive_line(rows.columns, F.col("qso_at"), {"0": "160m", "1": "80m"}, {"click": "CW", "view": "SSB"}, F.col("fields"), ["class", "their_park", "power"])
    return rows.select("uuid", line.alias("record"))


QUERIES["adif_archive"] = adif_archive
SQL["adif_archive"] = f"""WITH {CONTACTS} SELECT uuid, '<CALL:' || length('K' || uuid) || '>K' || uuid || ' <QSO_DATE:8>' || strftime(qso_at, '%Y%m%d') || ' <TIME_ON:6>' || strftime(qso_at, '%H%M%S')
  || CASE band WHEN '0' THEN ' <BAND:4>160m' WHEN '1' THEN ' <BAND:3>80m' ELSE '' END || CASE mode WHEN 'click' THEN ' <MODE:2>CW' WHEN 'view' THEN ' <MODE:3>SSB' ELSE '' END || ' <STATION_CALLSIGN:4>W1AW <OPERATOR:3>N0X <N3FJP_INITIALS:2>ab'
  || CASE WHEN uuid % 2 = 0 THEN ' <STATE:2>OR' ELSE '' END || ' <NAME:2>é <CLASS:2>3' || band || CASE WHEN uuid % 4 = 0 THEN ' <SIG:4>POTA <SIG_INFO:4>US-' || band ELSE '' END || ' <APP_RADIOLAKE_POWER:1>5 <EOR>' AS record FROM contacts"""


def sheet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dupe sheet's lines, with their place by all the columns before them."""
    entries = adif.dupe_sheet(contacts(spark, sf_dir).select(F.concat("band", F.lit("0m")).alias("band"), "mode", F.concat(F.lit("K"), F.col("operator").cast("string")).alias("call")), ["40m", "20m", "00m"])
    return adif.sheet_lines(entries).select("band_rank", "band", "mode", "kind", "line", "again")


QUERIES["sheet_lines"] = sheet_lines
SQL["sheet_lines"] = f"""WITH {CONTACTS}, g AS (SELECT CAST(CASE band WHEN '4' THEN 1 WHEN '2' THEN 2 WHEN '0' THEN 3 ELSE 4 END AS INTEGER) AS band_rank, band || '0' AS band, mode, 'K' || operator AS call, uuid FROM contacts)
SELECT band_rank, band, mode, 1 AS kind, call AS line, row_number() OVER (PARTITION BY band, mode, call ORDER BY uuid) AS again FROM g UNION ALL SELECT DISTINCT band_rank, band, mode, 0, band || ' ' || mode, 0 FROM g
UNION ALL SELECT band_rank, band, mode, 2, 'Total: ' || count(*), 0 FROM g GROUP BY band_rank, band, mode"""
