"""Readers of public activity lists; each gives ``call`` and ``value``, one row for each callsign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions.scalars import clean_call

#: What may stand between several stations in one cell.
BETWEEN_STATIONS = "[()&+,;\\s]+"


def folded(rows: DataFrame, call: Column, value: Column) -> DataFrame:
    """The largest value of each cleaned callsign; what can't be a callsign is left out."""
    return rows.select(clean_call(call).alias("call"), value.alias("value")).where("call IS NOT NULL").groupBy("call").agg(F.max("value").alias("value"))


def call_columns(names: list[str]) -> list[str]:
    """Columns of a results sheet that name stations: those with CALL, not a club's, and the second station's."""
    return [n for n in names if ("CALL" in n.upper() or "GOTA" in n.upper()) and "CLUB" not in n.upper()]


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if all lines of a text file are, else Latin-1, in which callsigns read as in the older sheets' code page."""
    return "UTF-8" if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"


def field_day(spark: SparkSession, path: str, year: int) -> DataFrame:
    """One year's results sheet; a cell may name several stations, ``?`` stands for a slashed zero."""
    sheet = spark.read.option("header", True).option("encoding", encoding_of(spark, path)).csv(path)
    sheet = sheet.withColumnsRenamed({c: c.lstrip("\ufeff") for c in sheet.columns})
    cells = F.explode(F.array(*[F.col(f"`{c}`") for c in call_columns(sheet.columns)]))
    stations = F.explode(F.split(F.replace("cell", F.lit("?"), F.lit("0")), BETWEEN_STATIONS))
    return folded(sheet.select(cells.alias("cell")).select(stations.alias("station")), F.col("station"), F.lit(year))


def winter_field_day(spark: SparkSession, path: str, year: int) -> DataFrame:
    """One year's results as a document with rows under ``aaData``."""
    rows = spark.read.option("multiLine", True).schema("aaData array<struct<callsign:string>>").json(path)
    return folded(rows.select(F.explode("aaData.callsign").alias("c")), F.col("c"), F.lit(year))


def park_activity(spark: SparkSession, path: str, call: str, number: str) -> DataFrame:
    """Activators or hunters: an array of documents with a callsign and a number."""
    rows = spark.read.option("multiLine", True).schema(f"`{call}` string, `{number}` long").json(path)
    return folded(rows, F.col(call), F.col(number))


def log_uploads(spark: SparkSession, path: str) -> DataFrame:
    """A list of callsign, date and time without a header; dates must be written YYYY-MM-DD."""
    rows = spark.read.schema("call string, day string, time string").csv(path)
    day = F.substring(F.trim("day"), 1, 10)
    return folded(rows.where(day.rlike("^\\d{4}-\\d{2}-\\d{2}$")), F.col("call"), day)


def club_log(spark: SparkSession, path: str) -> DataFrame:
    """A document keyed by callsign, cut at an underscore; who is in it counts, with or without a last date.

    Entries are flat objects, so Spark's reader splits the document after them, wherever a task's part of the file begins, and a document of any
    size is many tasks' work. An entry that isn't of that form raises.
    """
    pieces = spark.read.option("lineSep", "},").text(path)
    entry = F.regexp_extract_all("value", F.lit('"(?:[^"\\\\]|\\\\.)*"\\s*:\\s*\\{[^{}]*'), F.lit(0))
    read = F.from_json(F.concat(F.lit("{"), F.col("entry"), F.lit("}}")), "map<string,struct<lastqso:string>>")
    left = F.regexp_replace("value", '"(?:[^"\\\\]|\\\\.)*"\\s*:\\s*\\{[^{}]*', "")
    odd = F.raise_error(F.concat(F.lit("not an entry of a keyed document: "), F.substring("value", 1, 80)))
    rows = pieces.select(F.explode(F.when(left.rlike("^[\\s{},]*$"), entry).otherwise(odd)).alias("entry"))
    known = rows.select(F.explode(F.coalesce(read, F.raise_error(F.concat(F.lit("not an entry of a keyed document: "), F.substring("entry", 1, 80))))).alias("k", "v"))
    return folded(known, F.split_part("k", F.lit("_"), F.lit(1)), F.col("v.lastqso"))


def check_partial(spark: SparkSession, path: str) -> DataFrame:
    """A list of callsigns; blank lines and those that begin with ! or # don't count."""
    lines = spark.read.text(path).where("trim(value) <> ''").where(~F.substring(F.trim("value"), 1, 1).isin("!", "#"))
    return folded(lines, F.col("value"), F.lit(1))


def gazetteer(spark: SparkSession, path: str, names: tuple[str, str, str]) -> DataFrame:
    """Keys with coordinates from a list with a header, delimited by bars or tabs; rows that can't be read are skipped."""
    first = spark.read.text(path).first()
    sep = "|" if first and "|" in first[0] else "\t"
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    rows = rows.select(*[F.col(f"`{c}`").alias(c.strip()) for c in rows.columns])
    key, lat, lon = names
    return rows.select(F.trim(key).alias("key"), F.trim(lat).try_cast("double").alias("lat"), F.trim(lon).try_cast("double").alias("lon")).where("key <> '' AND lat IS NOT NULL AND lon IS NOT NULL")


def geocoder_results(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a batch geocoder: a match gives longitude and latitude, in that order; anything else is a miss."""
    rows = spark.read.schema("id string, address string, result string, kind string, matched_address string, place string").csv(path)
    pair = F.when(F.col("result") == "Match", F.split("place", ","))
    lon, lat = F.try_element_at(pair, F.lit(1)).try_cast("double"), F.try_element_at(pair, F.lit(2)).try_cast("double")
    found = lon.isNotNull() & lat.isNotNull()
    return rows.select("id", F.coalesce(found, F.lit(False)).alias("matched"), F.when(found, lat).alias("lat"), F.when(found, lon).alias("lon"))


def unmatched(rows: DataFrame, path: str, coordinates: str, order: str) -> None:
    """A report of the rows without coordinates."""
    rows.where(F.col(coordinates).isNull()).orderBy(order).write.option("header", True).csv(path)


def manifest_counts(spark: SparkSession, path: str) -> DataFrame:
    """Expected lines of each dump, by its tag, from lines like ``123 EN.dat``."""
    lines = spark.read.text(path)
    tag, n = F.regexp_extract("value", "(\\d+)\\s+(?:.*/)?(\\w+)\\.dat", 2), F.regexp_extract("value", "(\\d+)\\s+(?:.*/)?(\\w+)\\.dat", 1)
    return lines.where(tag != "").select(tag.alias("tag"), n.cast("long").alias("lines"))
