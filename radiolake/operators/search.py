"""Searches for parts of callsigns and for words in contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A search term's first characters by which terms and suffixes meet.
STEM = 2
# How many matches each source gives to a search, and what it is ordered by after the exact match.
SOURCE_LIMITS = {"fd": 6, "wfd": 6, "pota_hunter": 8, "pota_activator": 8, "lotw": 8, "clublog": 8, "scp": 8}
SOURCE_VALUES = {"fd": "fd_last_year", "wfd": "wfd_last_year", "pota_hunter": "pota_hunter_qsos", "pota_activator": "pota_activations", "lotw": "lotw_last_upload", "clublog": "clublog_last_qso"}


def matches(calls: DataFrame, terms: DataFrame, call: str = "call", term: str = "term") -> DataFrame:
    """Pairs of a term and a callsign that contains it; an empty term has none.

    A callsign is exploded into its suffixes, a suffix meets the terms that begin with its first characters, and the
    rest is compared. Terms of one character have their own, shorter stem. Each pair counts once.
    """
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.length(call)), lambda i: F.substring(F.col(call), i, F.length(call)))).alias("suffix")
    stems = calls.where(F.length(call) > 0).select("*", suffix).withColumn("stem", F.explode(F.array_distinct(F.array(F.substring("suffix", 1, 1), F.substring("suffix", 1, STEM)))))
    asked = terms.where(F.length(term) > 0).distinct().withColumn("stem", F.substring(term, 1, STEM))
    return stems.join(asked, "stem").where(F.startswith("suffix", F.col(term))).drop("stem", "suffix").dropDuplicates([term, call])


def _suffixes(calls: DataFrame, call: str) -> DataFrame:
    """``suffix``, ``at`` (where it begins) and ``call`` for each suffix of each distinct callsign."""
    each = calls.select(F.col(call).alias("call")).where(F.length(call) > 0).distinct()
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("call")), lambda i: F.substring(F.col("call"), i, F.length("call")))).alias("at", "suffix")
    return each.select("call", at).select("suffix", (F.col("at") + 1).alias("at"), "call")


def write_index(calls: DataFrame, path: str, call: str = "call", number: int = 0) -> None:
    """A stored index of all suffixes, sorted and cut by range, so that a term is a range that the files' statistics bound.

    An increment of another ``number`` stands beside the ones before it.
    """
    suffixes = _suffixes(calls, call)
    suffixes.repartitionByRange("suffix", "call").sortWithinPartitions("suffix", "call").write.mode("overwrite").parquet(f"{path}/increment={number}")


def extend_index(calls: DataFrame, path: str, call: str = "call") -> int:
    """Adds the callsigns that the index doesn't have as an increment; its number. Calls that it has cost one look at each."""
    index = calls.sparkSession.read.parquet(path)
    number = (index.agg(F.max("increment")).first()[0] or 0) + 1
    new = calls.join(index.where("at = 1").select(F.col("call").alias(call)), call, "left_anti")
    write_index(new, path, call, number)
    return number


def in_index(spark: SparkSession, path: str, terms: list[str], term: str = "term") -> DataFrame:
    """Pairs of a term and a callsign that contains it, by a stored index; empty terms have none, repeated ones count once.

    The terms are those of a search, so they are a list: each is a filter that reaches the scan, and files and row groups
    of other ranges aren't read. A callsign counts where it holds the term first, so nothing is shuffled to tell pairs apart, and a
    short term is as many tasks' work as its range has files.
    """
    asked = sorted({t for t in terms if t})
    index = spark.read.parquet(path)
    if not asked:
        return index.select(F.lit("").alias(term), "call").limit(0)
    hit = F.lit(False)
    for t in asked:
        hit = hit | F.startswith("suffix", F.lit(t))
    found = F.filter(F.array(*map(F.lit, asked)), lambda t: F.startswith("suffix", t) & (F.instr(F.col("call"), t) == F.col("at")))
    return index.where(hit).select(F.explode(found).alias(term), "call")


def top_matches(found: DataFrame, order: list[Column], k: int, call: str = "call", term: str = "term") -> DataFrame:
    """The best ``k`` matches of each term: the exact one first, then by ``order``, then by name; and if more exist."""
    w = Window.partitionBy(term).orderBy(F.col(call) != F.col(term), *order, F.col(call))
    ranked = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    more = F.max("place").over(Window.partitionBy(term)) > k
    return ranked.withColumn("truncated", more).where(F.col("place") <= k)


def by_source(found: DataFrame, call: str = "call", term: str = "term") -> DataFrame:
    """The best matches of each term in each of the seven sources: ``place``, ``value``, and if the source has more.

    Each pair of a term and a callsign goes to the sources that know the callsign, in one pass: the exact match comes
    first, then the newest year, the largest count or the latest date, a missing date last; the list of contest calls,
    which has no value, goes by the shortest call and then the number of sources. Ranks are cut off before the shuffle,
    so a term that most callsigns contain sends a few rows from each partition.
    """

    def source(name: str) -> Column:
        dated = name in ("lotw", "clublog")
        value = F.col(SOURCE_VALUES[name]) if name in SOURCE_VALUES else F.lit(None).cast("string")
        member = F.coalesce(F.col(name) == 1, F.lit(False)) if name in ("clublog", "scp") else value.isNotNull()
        plain = name == "scp"
        return F.struct(
            F.lit(name).alias("source"), F.lit(SOURCE_LIMITS[name]).alias("most"), member.alias("member"), value.cast("string").alias("value"),
            (F.lit(None) if dated or plain else value).cast("long").alias("number"), (value if dated else F.lit(None)).cast("string").alias("date"),
            (F.length(call) if plain else F.lit(0)).alias("length"), (F.col("source_count") if plain else F.lit(0)).cast("int").alias("known"),
        )

    each = found.select(term, F.col(call).alias("call"), F.explode(F.array(*map(source, SOURCE_LIMITS))).alias("s")).where("s.member").select(term, "call", "s.*")
    order = [F.col("call") != F.col(term), F.col("number").desc_nulls_last(), F.col("date").desc_nulls_last(), F.col("length"), F.desc("known"), F.col("call")]
    most = max(SOURCE_LIMITS.values())
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy(term, "source").orderBy(*order))).where(F.col("place") <= most + 1)
    more = F.max("place").over(Window.partitionBy(term, "source")) > F.col("most")
    return placed.withColumn("truncated", more).where("place <= most").select(term, "source", "place", "call", "value", "truncated")


def ranked_search(calls: DataFrame, query: str, k: int, call: str = "call", known: str = "source_count") -> DataFrame:
    """The best ``k`` callsigns that contain ``query``: exact, then those that begin with it, then shorter ones, then those
    that more sources know."""
    rank = F.when(F.col(call) == query, 0).when(F.startswith(call, F.lit(query)), 1).otherwise(2)
    return calls.where(F.contains(call, F.lit(query))).withColumn("match_rank", rank).orderBy("match_rank", F.length(call), F.desc(known), call).limit(k)


def with_tokens(rows: DataFrame, query: str, values: Column) -> DataFrame:
    """Rows in which every word of the query is part of some value, in any case; a blank query finds all."""
    tokens = query.lower().split()
    low = F.transform(values, lambda v: F.lower(F.coalesce(v, F.lit(""))))
    found = rows
    has = lambda token: F.exists(low, lambda v: F.contains(v, F.lit(token)))
    for token in tokens:
        found = found.where(has(token))
    return found


def latest(rows: DataFrame, at: str, ident: str, k: int = 50) -> DataFrame:
    """The ``k`` latest rows; the limit is the report's own."""
    return rows.orderBy(F.desc(at), F.desc(ident)).limit(k)
