"""Statistics of a contact log: rates, favourites, totals, gaps, histograms.

Every function takes contacts with ``uuid``, ``qso_at``, ``operator``, ``mode`` and ``band`` and pre-aggregates
before it ranks, so that a hot operator costs one row for each value rather than one for each contact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from radiolake.functions.scalars import lookup
from radiolake.operators.log import matched
from radiolake.shared import ranked, staged


def rounded(x: Column) -> Column:
    """Half-up rounding to a whole number."""
    return F.floor(x + F.lit(0.5)).cast("long")


def sliding_hour(contacts: DataFrame, key: str = "operator") -> DataFrame:
    """The most contacts of each key in any 60 minutes, both ends included.

    Two contacts exactly an hour apart count together. Null times are left out. A window that ends in some hour begins
    in it or in the hour before, so each contact goes to its own hour and to the next, and windows are counted within
    an hour of a key: a key with most of the contacts is as many tasks' work as it has hours.
    """
    micros = F.unix_micros(F.col("qso_at").cast("timestamp"))
    timed = contacts.where("qso_at IS NOT NULL").select(key, micros.alias("t")).withColumn("own", F.floor(F.col("t") / 3_600_000_000))
    dealt = timed.withColumn("hour", F.explode(F.array("own", F.col("own") + 1)))
    ends = Window.partitionBy(key, "hour").orderBy("t").rangeBetween(-3_600_000_000, 0)
    counted = dealt.withColumn("n", F.count("*").over(ends)).where("own = hour")
    return counted.groupBy(key).agg(F.max("n").alias("best_hour"))


def favourite(contacts: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; a tie goes to the value that was seen first."""
    counted = contacts.groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct("qso_at", "uuid")).alias("seen"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "seen")))
    return ranked.where("r = 1").select(key, F.col(value).alias(f"top_{value}"), F.col("n").alias(f"top_{value}_n"))


def operator_report(contacts: DataFrame) -> DataFrame:
    """Total, best sliding hour, favourite band and mode with their share in per cent, for each operator.

    Contacts without an operator are one operator's; an operator whose contacts have no time has a best hour of 0.
    """
    out = contacts.groupBy("operator").agg(F.count("*").alias("total"))
    for value, more in (("hour", sliding_hour(contacts)), *((v, favourite(contacts, "operator", v)) for v in ("band", "mode"))):
        joined = matched(out, more, ["operator"], "left")
        if value == "hour":
            out = joined.select("operator", "total", F.coalesce("best_hour", F.lit(0)).cast("long").alias("best_hour"))
        else:
            share = rounded(F.col(f"top_{value}_n") * F.lit(100.0) / F.col("total")).alias(f"top_{value}_pct")
            out = joined.select(*out.columns, f"top_{value}", share)
    return out


def longest_gap(contacts: DataFrame) -> DataFrame:
    """The longest time between two consecutive contacts of the whole log, in ms, and its ``XhYm`` label.

    Gaps are taken within each hour, then between the last contact of an hour and the first of the next hour that has
    any, so only one row for each hour meets in one task. Fewer than two contacts: null and a dash.
    """
    ms = F.floor(F.unix_micros(F.col("qso_at").cast("timestamp")) / 1000).cast("long")
    timed = contacts.where("qso_at IS NOT NULL").select(ms.alias("ms")).withColumn("hour", F.floor(F.col("ms") / 3600000))
    within = timed.select("hour", (F.col("ms") - F.lag("ms").over(Window.partitionBy("hour").orderBy("ms"))).alias("gap"))
    hours = timed.groupBy("hour").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    between = hours.select("hour", (F.col("first") - F.lag("last").over(Window.orderBy("hour"))).alias("gap"))
    gap = within.unionByName(between).agg(F.max("gap").alias("gap_ms"))
    minutes = rounded(F.col("gap_ms") / 60000)
    label = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))
    return gap.select("gap_ms", F.coalesce(label, F.lit("-")).alias("label"))


def band_mode_cube(contacts: DataFrame) -> DataFrame:
    """Counts by band and mode with totals of either and of both, marked ``*``."""
    counted = contacts.groupBy("band", "mode").agg(F.count("*").alias("n"))
    cube = counted.cube("band", "mode").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    name = lambda c, bit: F.when(F.col("g").bitwiseAND(F.lit(bit)) > 0, F.lit("*")).otherwise(F.col(c)).alias(c)
    return cube.select(name("band", 2), name("mode", 1), "n")


def band_mode_pivot(contacts: DataFrame, modes: list[str]) -> DataFrame:
    """One row for each band with a column for each of the given modes; pairs that never occur are 0."""
    return contacts.groupBy("band").pivot("mode", modes).count().na.fill(0, modes)


def histogram(contacts: DataFrame, seconds: int) -> DataFrame:
    """Contacts and hourly rate in bins of fixed width from the first to the last one, empty bins included.

    Bins start at whole multiples of the width since 1970 and come from the counts' ends, not from the contacts. Times
    farther from the median than OUTLIER_DAYS are typing errors and are left out, so the number of bins has a bound.
    """
    at = F.col("qso_at").cast("timestamp")
    near = contacts.where("qso_at IS NOT NULL").where(F.abs(F.unix_millis(at) - _middle(contacts)) <= OUTLIER_DAYS * 86_400_000)
    counted = staged(near.select(F.floor(F.unix_seconds(at) / seconds).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")))
    every = counted.agg(F.min("bin").alias("a"), F.max("bin").alias("z")).select(F.explode(F.expr("sequence(a, z)")).alias("bin"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return every.join(counted, "bin", "left").select((F.col("bin") * seconds).alias("bin_start"), n.alias("n"), rounded(n * F.lit(3600.0 / seconds)).alias("rate"))


def upper_median(contacts: DataFrame) -> DataFrame:
    """The time at place floor(n / 2), counted from 0, of the log in order, as ``median_ms``.

    Counts by hour tell in which hour it is; only that hour's contacts are ranked.
    """
    ms = F.floor(F.unix_micros(F.col("qso_at").cast("timestamp")) / 1000).cast("long")
    timed = contacts.where("qso_at IS NOT NULL").select(ms.alias("ms")).withColumn("hour", F.floor(F.col("ms") / 3600000))
    hours = staged(timed.groupBy("hour").agg(F.count("*").alias("n")))
    upto = F.sum("n").over(Window.orderBy("hour"))
    middle = hours.agg(F.floor(F.sum("n") / 2)).scalar()
    placed = hours.select("hour", upto.alias("upto"), F.col("n").alias("here")).withColumn("k", middle)
    at = placed.where("k < upto AND k >= upto - here").select("hour", (F.col("k") - F.col("upto") + F.col("here")).alias("skip"))
    inside = timed.join(F.broadcast(at), "hour").withColumn("r", F.row_number().over(Window.partitionBy("hour").orderBy("ms")) - 1)
    return inside.where("r = skip").select(F.col("ms").alias("median_ms"))


def without_outliers(contacts: DataFrame, days: int) -> DataFrame:
    """The median time, how many contacts are within so many days of it, and the first and last of them."""
    ms = F.floor(F.unix_micros(F.col("qso_at").cast("timestamp")) / 1000).cast("long")
    near = contacts.select(ms.alias("ms")).withColumn("median_ms", upper_median(contacts).scalar()).where(F.abs(F.col("ms") - F.col("median_ms")) <= days * 86_400_000)
    return near.groupBy("median_ms").agg(F.count("*").alias("kept"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def _middle(contacts: DataFrame) -> Column:
    """The median time in ms as a constant, so that what is held against it reads the contacts once."""
    found = upper_median(contacts).first()
    return F.lit(found and found[0]).cast("long")


#: Fixed values of the rate graph: widths of bins in minutes, bins that a graph may have, days around the median.
BIN_MINUTES, MOST_BINS, OUTLIER_DAYS = (5, 10, 15, 30, 60, 120, 240, 360, 720, 1440), 50, 30


def rate_graph(contacts: DataFrame) -> DataFrame:
    """Contacts by bin and mode with the bin's rate for an hour: the rows of a rate graph, empty bins included.

    Times far from the median are typing errors and are left out, so the number of bins has a bound. The width is the
    narrowest for which the graph has few enough bins. Bins start at whole multiples of it since 1970. Null modes are
    ``Unknown``; a bin without contacts has one row with a null mode. ``top`` is the graph's end: the largest rate,
    rounded up to 1, 2 or 5 times a power of ten.
    """
    ms = F.floor(F.unix_micros(F.col("qso_at").cast("timestamp")) / 1000).cast("long")
    timed = contacts.where("qso_at IS NOT NULL").select(ms.alias("ms"), F.coalesce(F.nullif("mode", F.lit("")), F.lit("Unknown")).alias("mode"))
    kept = timed.where(F.abs(F.col("ms") - _middle(contacts)) <= OUTLIER_DAYS * 86_400_000)
    # one pass over the contacts: a row for each minute and mode, of which all that follows is made
    by_minute = staged(kept.groupBy(F.floor(F.col("ms") / 60_000).alias("minute"), "mode").agg(F.count("*").alias("n"), F.min("ms").alias("a"), F.max("ms").alias("z")))
    first, last = by_minute.agg(F.min("a"), F.max("z")).first()
    width = next((m for m in BIN_MINUTES if first is not None and math.ceil((last - first) / (m * 60_000)) <= MOST_BINS), BIN_MINUTES[-1])
    counted = by_minute.withColumn("minutes", F.lit(width)).groupBy("minutes", F.floor(F.col("minute") / width).alias("bin"), "mode").agg(F.sum("n").alias("n"))
    bins = counted.groupBy("minutes", "bin").agg(F.sum("n").alias("all"))
    every = bins.groupBy("minutes").agg(F.min("bin").alias("a"), F.max("bin").alias("z")).select("minutes", F.explode(F.sequence("a", "z")).alias("bin"))
    full = every.join(bins, ["minutes", "bin"], "left").join(counted, ["minutes", "bin"], "left")
    rate = (F.coalesce("all", F.lit(0)) * 60 / F.col("minutes")).alias("rate")
    top = F.greatest(F.lit(1.0), F.lit(bins.agg(F.max(F.col("all") * 60 / F.col("minutes"))).first()[0]).cast("double"))
    power = F.pow(F.lit(10.0), F.floor(F.log10("__top")))
    step = F.when(F.col("__top") <= power, power).when(F.col("__top") <= 2 * power, 2 * power).when(F.col("__top") <= 5 * power, 5 * power).otherwise(10 * power)
    out = full.select((F.col("bin") * F.col("minutes") * 60).alias("bin_start"), "minutes", "mode", F.coalesce("n", F.lit(0)).cast("long").alias("n"), rate)
    return out.withColumn("__top", top).withColumn("top", step).drop("__top")


def tally(contacts: DataFrame, value: str) -> DataFrame:
    """Counts by value, blank and null as ``Unknown``, with their places: most first, ties by who was seen first."""
    named = F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("Unknown"))
    counted = contacts.groupBy(named.alias("name")).agg(F.count("*").alias("n"), F.min(F.struct("qso_at", "uuid")).alias("seen"))
    return ranked(counted, F.desc("n"), F.col("seen.qso_at"), F.col("seen.uuid"), name="place").select("name", "n", (F.col("place") + 1).alias("place"))


def kpis(contacts: DataFrame) -> DataFrame:
    """Totals, distinct operators, last hour, rate of the last quarter, average rate; ``now`` is the last contact."""
    t = F.col("qso_at")
    counted = contacts.withColumn("now", contacts.agg(F.max("qso_at")).scalar()).groupBy("now").agg(
        F.count("*").alias("total"),
        F.countDistinct("operator").alias("operators"),
        F.count_if(t >= F.col("now") - F.expr("INTERVAL 60 MINUTES")).alias("last_hour"),
        (F.count_if(t >= F.col("now") - F.expr("INTERVAL 15 MINUTES")) * 4).alias("quarter_rate"),
        F.min(t).alias("first"),
    )
    hours = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / F.lit(3.6e9)
    average = F.when(hours > 0, rounded(F.col("total") / hours)).otherwise(F.lit(0)).cast("long")
    return counted.select("total", "operators", "last_hour", "quarter_rate", average.alias("average_rate"))


def worked_top(contacts: DataFrame, section: str, limit: int = 10) -> DataFrame:
    """The most worked sections, upper-cased, blanks left out; a top-k report, ties by name."""
    name = F.upper(F.trim(section))
    return contacts.where(name != "").groupBy(name.alias("section")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section").limit(limit)


def breakdown(rows: DataFrame, value: str, blank: str = "(none)") -> DataFrame:
    """Counts by trimmed value, null and blank under one name."""
    return rows.groupBy(F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(blank)).alias("value")).agg(F.count("*").alias("n"))


def unmapped(contacts: DataFrame, maps: dict[str, dict[str, str]]) -> DataFrame:
    """``key``, ``value`` and ``n`` of the trimmed values of mapped columns for which their map has nothing."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.trim(c).alias("value"), lookup(m, F.trim(c)).alias("to")) for c, m in maps.items()])).alias("p")
    return contacts.select(pairs).select("p.*").where((F.col("value") != "") & (F.coalesce("to", F.lit("")) == "")).groupBy("key", "value").agg(F.count("*").alias("n"))


def missing(tracked: DataFrame, worked: DataFrame, key: str) -> DataFrame:
    """Tracked keys that nothing in ``worked`` has, compared in upper case."""
    seen = worked.select(F.upper(key).alias("__seen")).distinct()
    return tracked.join(seen, F.upper(key) == F.col("__seen"), "left_anti")
