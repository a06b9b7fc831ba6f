"""Submissions: which value a tag takes, park tags, names of files, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions.scalars import lookup
from radiolake.sources.adif import APP, BUILTIN_TAGS, dupe_sheet, sheet_lines, tag


def submission_value(name: str, prompts: dict[str, str], meta: dict[str, str], columns: list[str], fields: Column) -> Column:
    """A tag's value: the prompt's answer if it was asked, blank or not; else the event's, the contact's, a custom field's."""
    if name in prompts:
        return F.lit(prompts[name])
    if name in meta:
        return F.lit(meta[name])
    return F.col(name) if name in columns else F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit(""))


def park_tags(mine: Column, theirs: Column) -> list[Column]:
    """Three tags for the own park and three for the other's, each only if the park is given."""
    given = lambda park, name, value: F.when(F.trim(F.coalesce(park, F.lit(""))) != "", tag(name, value)).otherwise("")
    out = []
    for prefix, park in (("MY_", mine), ("", theirs)):
        out += [given(park, f"{prefix}SIG", F.lit("POTA")), given(park, f"{prefix}SIG_INFO", park), given(park, f"{prefix}POTA_REF", park)]
    return out


def first_day(contacts: DataFrame, at: str, prefix: str) -> DataFrame:
    """The name of an export: the earliest day of its contacts; times that can't be read don't count."""
    day = F.date_format(F.min(F.try_to_timestamp(at)), "yyyyMMdd")
    return contacts.agg(F.concat(F.lit(prefix), F.lit("-"), day, F.lit(".adi")).alias("file_name"))


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Writes every table as JSON lines under its name."""
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")


def location_line(place: Column, km: Column, degrees: Column) -> Column:
    """``Place (12mi / 95°)`` with as much of the brackets as is known; blank without a place."""
    miles = F.format_number(F.floor(km * F.lit(0.621371) + F.lit(0.5)).cast("long"), 0)
    inside = F.concat_ws(" / ", F.concat(miles, F.lit("mi")), F.concat(degrees.cast("string"), F.lit("°")))
    named = F.nullif(place, F.lit(""))
    return F.coalesce(F.when(inside == "", named).otherwise(F.concat(named, F.lit(" ("), inside, F.lit(")"))), F.lit(""))


def operator_line(name: Column, license_class: Column) -> Column:
    """``Name (Class)``, or the one that is known; each word of the class begins with a capital."""
    named, words = F.nullif(name, F.lit("")), F.nullif(F.initcap(license_class), F.lit(""))
    return F.coalesce(F.concat(named, F.lit(" ("), words, F.lit(")")), named, words, F.lit(""))


def backup(df: DataFrame, base: str, slug: str, stamp: str) -> str:
    """A dated copy of a table; the one of the same name and stamp stays as it is and raises. Returns where it is."""
    path = f"{base}/{slug}-{stamp}"
    df.write.mode("error").parquet(path)
    return path


def pota_line(contacts: DataFrame, order: list[str], prompts: dict[str, str], meta: dict[str, str]) -> Column:
    """A record of the parks' programme: the template's fields in order, and three tags for each given park."""
    value = lambda n: submission_value(n, prompts, meta, contacts.columns, F.col("fields"))
    tags = []
    for name in order:
        if name == "my_park":
            tags += park_tags(value(name), F.lit(None).cast("string"))
        elif name == "their_park":
            tags += park_tags(F.lit(None).cast("string"), value(name))
        else:
            tags.append(tag(name.upper(), value(name)))
    return F.concat(F.array_join(F.filter(F.array(*tags), lambda t: t != ""), " "), F.lit(" <EOR>"))


# The submissions' tags of a contact's columns; a template may give others, and other names are the engine's own.
SUBMISSION_TAGS = {"station_callsign": "STATION_CALLSIGN", "operator_callsign": "OPERATOR", "remote_callsign": "CALL", "band": "BAND", "mode": "MODE", "my_state": "MY_STATE"} | BUILTIN_TAGS


def _record(contacts: DataFrame, config: dict, prompts: dict[str, str], meta: dict[str, str], parks: bool) -> Column:
    maps = {"band": config.get("band_map"), "mode": config.get("mode_map")}
    tags = []
    for name in config.get("fields", []):
        value = submission_value(name, prompts, meta, contacts.columns, F.col("fields"))
        if maps.get(name) is not None:
            value = lookup(maps[name], F.trim(value.cast("string"))) if maps[name] else F.lit("")
        if parks and name in ("my_park", "their_park"):
            tags += park_tags(value, F.lit("")) if name == "my_park" else park_tags(F.lit(""), value)
        elif name == "qso_at":
            at = value.cast("timestamp")
            tags += [tag("QSO_DATE", F.date_format(at, "yyyyMMdd")), tag("TIME_ON", F.date_format(at, "HHmmss"))]
        else:
            tags.append(tag(config.get("tags", {}).get(name) or SUBMISSION_TAGS.get(name, f"{APP}{name.upper()}"), value))
    return F.concat_ws(" ", F.filter(F.array(*tags), lambda t: t != "") if tags else F.array().cast("array<string>"), F.lit("<EOR>"))


def adif_submission(contacts: DataFrame, config: dict, prompts: dict[str, str], meta: dict[str, str]) -> DataFrame:
    """Contacts with their ``record`` of a contest's log: the template's ``fields`` in order, by its ``tags`` before the standard ones.

    A declared ``band_map`` or ``mode_map`` is complete: what it doesn't list is left out. No name has a meaning of its own but the time.
    """
    return contacts.withColumn("record", _record(contacts, config, prompts, meta, False))


def pota_submission(contacts: DataFrame, config: dict, prompts: dict[str, str], meta: dict[str, str]) -> DataFrame:
    """As :func:`adif_submission`, but a park, own or other, becomes the three tags of its programme."""
    return contacts.withColumn("record", _record(contacts, config, prompts, meta, True))


def dupe_sheet_submission(contacts: DataFrame, config: dict, prompts: dict[str, str], meta: dict[str, str]) -> DataFrame:
    """The lines of a dupe sheet: the station's line first (``band_rank`` 0), then :func:`~radiolake.sources.adif.sheet_lines`."""
    head = f"Call Used: {meta.get('station_callsign') or ''}  Class: {prompts.get('my_class') or ''}  ARRL Section: {prompts.get('my_section') or ''}"
    modes = config.get("mode_map")
    mode = F.col("mode") if modes is None else lookup(modes, F.trim("mode")) if modes else F.lit("")
    rows = contacts.select(F.trim("band").alias("band"), F.trim(mode).alias("mode"), F.trim("remote_callsign").alias("call"))
    lines = sheet_lines(dupe_sheet(rows, config.get("bands", [])))
    first = contacts.sparkSession.range(1).select(*[F.lit({"band_rank": 0, "kind": 0, "again": 0, "line": head}.get(c, "")).cast(t).alias(c) for c, t in lines.dtypes])
    return first.unionByName(lines)


def _named(parts: list) -> Callable[[DataFrame, dict, dict], DataFrame]:
    """A file's name from its parts: text, or a function of the answers, the event and the earliest day (blank without one)."""

    def file_name(contacts: DataFrame, prompts: dict[str, str], meta: dict[str, str]) -> DataFrame:
        day = F.coalesce(F.date_format(F.min(F.try_to_timestamp(F.col("qso_at").cast("string"))), "yyyyMMdd"), F.lit(""))
        return contacts.agg(day.alias("day")).select(F.concat(*[F.lit(p) if isinstance(p, str) else p(prompts, meta, F.col("day")) for p in parts]).alias("file_name"))

    return file_name


def _call(prompts: dict, meta: dict, day: Column) -> Column:
    return F.lit(meta.get("station_callsign") or "CALL")


def _park(prompts: dict, meta: dict, day: Column) -> Column:
    return F.lit(prompts.get("my_park") or "PARK")


def _day(prompts: dict, meta: dict, day: Column) -> Column:
    return day


def _year(prompts: dict, meta: dict, day: Column) -> Column:
    return F.when(day == "", "log").otherwise(F.substring(day, 1, 4))


#: Formats of a submission: what each is called, the name of its file (a table of one row), and what makes its records or lines.
FORMATS = {
    "pota": {"label": "POTA", "file_name": _named([_call, "@", _park, "-", _day, ".adi"]), "build": pota_submission},
    "adif": {"label": "ADIF", "file_name": _named([_call, "-", _year, ".adi"]), "build": adif_submission},
    "dupesheet": {"label": "Dupe Sheet", "file_name": _named([_year, "-FD-", _call, ".dup"]), "build": dupe_sheet_submission},
}
