"""Importing a log file: which records can be used, what they become, and what isn't new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions import scalars
from radiolake.operators import log
from radiolake.sources import adif

# Which tags give the built-in fields, the first that a record has; longest callsign and initials.
BUILTIN_SOURCES = {
    "frequency": ["FREQ"], "rst_sent": ["RST_SENT"], "rst_received": ["RST_RCVD"], "gridsquare": ["GRIDSQUARE", "GRID"], "name": ["NAME"],
    "state": ["STATE"], "county": ["CNTY"], "country": ["COUNTRY"], "comment": ["COMMENT"],
}
LONGEST_CALL, LONGEST_INITIALS = 12, 3


def of(name: str) -> Column:
    """A record's data under a tag; null if it hasn't the tag."""
    return F.try_element_at("fields", F.lit(name))


def builtin(name: str) -> Column:
    """A built-in field's value from the tags that may give it, blank if none does."""
    return F.coalesce(*map(of, BUILTIN_SOURCES[name]), F.lit("")) if name in BUILTIN_SOURCES else F.lit("")


def their_park() -> Column:
    """The other station's park, if the record's programme is the parks' one; else blank."""
    parks = F.upper(F.trim(F.coalesce(of("SIG"), F.lit("")))) == "POTA"
    return F.when(parks, F.coalesce(of("SIG_INFO"), F.lit(""))).otherwise("")


def field_value(name: str) -> Column:
    return their_park() if name == "their_park" else builtin(name)


def identity(tag: str, longest: int) -> Column:
    """An operator's callsign or initials as a form would take them; blank if the record has none."""
    return F.substring(F.upper(scalars.plain_text(F.coalesce(of(tag), F.lit("")))), 1, longest)


def marked(records: DataFrame, required: dict[str, str]) -> DataFrame:
    """Records with ``at`` (null if the time can't be read), ``usable`` and ``unmet``, the required fields without a value.

    ``required`` has the default of each required field; a blank one leaves a field unmet that the record doesn't give.
    """
    at = adif.timestamp(F.col("fields"))
    unmet = [F.when(log.blank(field_value(name)), F.lit(name)) for name, default in required.items() if not default.strip()]
    usable = ~log.blank(of("CALL")) & at.isNotNull()
    names = F.filter(F.array(*unmet), lambda n: n.isNotNull()) if unmet else F.array().cast("array<string>")
    return records.withColumn("at", at).withColumn("usable", usable).withColumn("unmet", names)


def contacts(records: DataFrame, required: dict[str, str], modes: dict[str, str], bands: dict[str, str], offset: tuple[int, int, int], operator: str, initials: str, with_parks: bool) -> DataFrame:
    """What the usable records that can be stored become: call, time, band, mode, identity, built-in and other fields.

    Modes and bands go by their maps, in any case, else to ``Other``; times are moved by the offset in days, hours and
    minutes; a record without an operator or initials takes the given ones; blank required fields take their default.
    """
    rows = marked(records, required).where("usable AND size(unmet) = 0")
    given = lambda name, value: F.when(log.blank(value), F.lit(required[name])).otherwise(value) if name in required else value
    park = their_park() if with_parks else F.lit("")
    others = {n: given(n, park if n == "their_park" else F.lit("")) for n in [*(["their_park"] if with_parks else []), *[n for n in required if n not in BUILTIN_SOURCES and n != "their_park"]]}
    entries = [e for n, v in others.items() for e in (F.lit(n), v)]
    return rows.select(
        "position", F.upper(F.trim(of("CALL"))).alias("remote_callsign"), scalars.shifted(F.col("at"), *offset).alias("qso_at"),
        scalars.mapped(F.coalesce(of("BAND"), F.lit("")), bands, "Other").alias("band"), scalars.mapped(F.coalesce(of("MODE"), F.lit("")), modes, "Other").alias("mode"),
        F.coalesce(F.nullif(identity("OPERATOR", LONGEST_CALL), F.lit("")), F.lit(operator.strip().upper())).alias("operator"),
        F.coalesce(F.nullif(identity("N3FJP_INITIALS", LONGEST_INITIALS), F.lit("")), F.lit(initials.strip().upper())).alias("initials"),
        *[given(name, builtin(name)).alias(name) for name in BUILTIN_SOURCES],
        (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("fields"),
    )


def tallies(records: DataFrame, required: dict[str, str], labels: dict[str, str], new: DataFrame) -> DataFrame:
    """One row: all records, those that can't be used, usable ones that can't be stored and why, ones without operator or
    initials, what isn't new, and what is imported. ``new`` are the contacts that are new, of those that :func:`contacts` makes of the records."""
    counted = marked(records, required).agg(
        F.count("*").alias("total"), F.count_if(~F.col("usable")).alias("bad"),
        F.count_if(F.col("usable") & (F.size("unmet") > 0)).alias("unsyncable"), F.count_if(F.col("usable") & (F.size("unmet") == 0)).alias("__stored"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("usable"), F.col("unmet")))))), ",").alias("__unmet"),
        F.count_if(F.col("usable") & (identity("OPERATOR", LONGEST_CALL) == "")).alias("missing_operator"),
        F.count_if(F.col("usable") & (identity("N3FJP_INITIALS", LONGEST_INITIALS) == "")).alias("missing_initials"),
    )
    named = F.col("__unmet")
    for name, label in labels.items():
        named = F.regexp_replace(named, f"\\b{name}\\b", label)
    out = counted.withColumn("imported", new.agg(F.count("*")).scalar()).withColumn("dupes", F.col("__stored") - F.col("imported"))
    return out.select("total", "bad", "unsyncable", named.alias("unsyncable_fields"), "missing_operator", "missing_initials", "dupes", "imported")
