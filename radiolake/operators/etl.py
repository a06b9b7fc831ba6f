"""Building verified tables: merging dumps, geocode caches, repairs, checks, atomic publishing."""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import geo, places, scalars
from radiolake.operators import log
from radiolake.shared import staged


def merge_dumps(entities: DataFrame, headers: DataFrame, extras: DataFrame, key: str, position: str) -> DataFrame:
    """Entities with an active header, the header's columns, and the last extra row of the key where there is any.

    ``headers`` has one row for each key; only those with status ``A`` count. ``extras`` may repeat a key: the row with
    the largest position wins.
    """
    live = headers.where("status = 'A'").drop("status")
    others = [c for c in extras.columns if c not in (key, position)]
    last = extras.groupBy(key).agg(F.max_by(F.struct(*others), position).alias("x")).select(key, "x.*")
    return entities.join(live, key).join(last, key, "left")


def address_key(*parts: Column) -> Column:
    """Trimmed upper-case parts in one text, null as blank, so that rows without a city still meet."""
    return F.concat_ws("|", *[F.coalesce(F.upper(F.trim(p)), F.lit("")) for p in parts])


def with_coordinates(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows with the coordinates that the cache has for their address; of repeated answers the last one fetched."""
    last = F.max_by("coordinates", F.struct("fetched_at", "coordinates")).alias("coordinates")
    return rows.join(cache.where("matched").groupBy(key).agg(last), key, "left")


def to_geocode(rows: DataFrame, cache: DataFrame, key: str, cutoff) -> DataFrame:
    """Distinct addresses that the cache doesn't answer: not in it, or a miss from before the cutoff."""
    fresh = cache.where(F.col("matched") | (F.col("fetched_at") >= F.lit(cutoff))).select(key)
    return rows.select(key).distinct().join(fresh, key, "left_anti")


def cache_counts(rows: DataFrame, cache: DataFrame, key: str, cutoff) -> DataFrame:
    """How many distinct addresses the cache answers, how many are known misses that are still fresh, how many are to do."""
    last = cache.groupBy(key).agg(F.max("matched").alias("hit"), F.max(F.col("fetched_at") >= F.lit(cutoff)).alias("fresh"))
    state = rows.select(key).distinct().join(last, key, "left").select(F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("fresh", F.lit(False)).alias("fresh"))
    return state.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit") & F.col("fresh")).alias("fresh_misses"), F.count_if(~F.col("hit") & ~F.col("fresh")).alias("to_do"))


def suspect_coordinates(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows whose coordinates are a placeholder or impossible, with the ``problem``."""
    y, x = F.col(lat), F.col(lon)
    problem = F.when((y == 0) & (x == 0), "placeholder").when(~y.between(-90, 90) | ~x.between(-180, 180), "impossible")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def drift(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    side = lambda a, b, name: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("only_in", F.lit(name))
    return side(left, right, "left").unionByName(side(right, left, "right"))


def missing_numbers(rows: DataFrame, number: str, most: int) -> DataFrame:
    """Numbers from 1 to ``most`` that no row has."""
    every = rows.sparkSession.range(1, most + 1).select(F.col("id").alias(number))
    return every.join(rows.select(F.col(number).cast("long")).distinct(), number, "left_anti")


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """How many parents have no child, and children no parent."""
    a = parents.join(children.select(key), key, "left_anti").agg(F.count("*").alias("without_children"))
    b = children.join(parents.select(key), key, "left_anti").agg(F.count("*"))
    return a.withColumn("without_parent", b.scalar())


def quality_counters(rows: DataFrame, reference: str, lat: str, lon: str) -> DataFrame:
    """Totals, distinct prefixes, missing, placeholder and impossible coordinates in one pass."""
    y, x = F.col(lat), F.col(lon)
    return rows.agg(
        F.count("*").alias("total"),
        F.countDistinct(F.split_part(reference, F.lit("-"), F.lit(1))).alias("prefixes"),
        F.count_if(y.isNull() | x.isNull()).alias("missing"),
        F.count_if((y == 0) & (x == 0)).alias("placeholders"),
        F.count_if(~y.between(-90, 90) | ~x.between(-180, 180)).alias("impossible"),
    )


def best_spelling(rows: DataFrame, key: str, spelling: str, position: str) -> DataFrame:
    """For each key the spelling with the most characters beyond ASCII; the first one on a tie."""
    accents = F.octet_length(spelling) - F.char_length(spelling)
    return rows.groupBy(key).agg(F.max_by(spelling, F.struct(accents, -F.col(position))).alias(spelling))


def pick(candidates: Column, acceptable, preferred) -> Column:
    """The first acceptable candidate that is preferred, else the first acceptable one."""
    ok = F.filter(candidates, acceptable)
    return F.coalesce(F.try_element_at(F.filter(ok, preferred), F.lit(1)), F.try_element_at(ok, F.lit(1)))


def pick_places(candidates: DataFrame, key: str) -> DataFrame:
    """For each key the place of its first candidate that is the street asked for, and of the one that is its town.

    ``candidates`` has ``position``, ``type``, ``title``, ``qualifier``, ``lat`` and ``lon`` of the answers, and what was
    asked for: ``street``, ``city``, ``province`` (null: any). A street answer must be of the province and share a
    variant of the name; its town isn't looked at, as large cities answer for their parts. A town must have the same
    name and not be a province or country; populated kinds come first. Answers without a place don't count. The choice
    is one aggregation over the candidates, so a key may have any number. What an answer's texts are to what was asked is found
    once for each different combination and joined to the candidates, by a broadcast only if they are few.
    """
    texts = ["type", "title", "street", "city", "province"]
    name, province, kind = places.title_parts(F.col("title"))
    asked = candidates.select(*texts).distinct().withColumns({"__name": name, "__province": province, "__kind": kind, "__key": places.place_key(F.col("city"))})
    here = F.col("province").isNull() | (F.lower("province") == F.lower("__province"))
    # names are compared only where the rest is right
    is_street = F.when(here & F.col("type").rlike("(Street|Address)$"), places.same_street(F.col("street"), F.col("__name"))).otherwise(False)
    is_town = here & F.endswith("type", F.lit("Geoname")) & ~F.col("__kind").isin(*places.TOO_LARGE) & (F.col("__key") != "") & (places.place_key(F.col("__name")) == F.col("__key"))
    judged = staged(asked.select(*texts, is_street.alias("__street"), is_town.alias("__town"), F.col("__kind").isin(*places.POPULATED).alias("__populated")))
    rows = log.matched(candidates, judged, texts, "inner")
    usable = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    precise = F.when(F.col("qualifier") == "INTERPOLATED_POSITION", "Street").otherwise("Street_Approx")
    street = F.min(F.when(usable & F.col("__street"), F.struct("position", "lat", "lon", precise.alias("how"))))
    town = F.min(F.when(usable & F.col("__town"), F.struct(~F.col("__populated"), "position", "lat", "lon")))
    found = rows.groupBy(key).agg(street.alias("s"), town.alias("t"))
    return found.select(key, F.coalesce("s.lat", "t.lat").alias("lat"), F.coalesce("s.lon", "t.lon").alias("lon"), F.coalesce("s.how", F.when(F.col("t").isNotNull(), F.lit("City_Centroid"))).alias("how"))


def largest_member(rows: DataFrame, members: DataFrame, region: str, column: str) -> DataFrame:
    """Rows without a place take the point of their region's largest member (``point``, ``area``, ``ident``)."""
    largest = members.groupBy(region).agg(F.max_by("point", F.struct("area", "ident")).alias("__point"))
    return rows.join(largest, region, "left").withColumn(column, F.coalesce(column, "__point")).drop("__point")


#: Fixed value: kilometres that a place may be outside its postal area, whatever the area's size.
POSTAL_FLOOR_KM = 5.0


def postal_checked(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows placed by their postal area where they have no place or one too far outside it: ``lat``, ``lon`` and ``how``.

    ``rows`` has ``postal``, ``province``, ``lat``, ``lon``, ``how``; ``areas`` has ``area``, ``rings``, ``km2`` and an inner point
    (``mid_lat``, ``mid_lon``). Too far is farther than the radius of a circle of the area's size, but at least
    POSTAL_FLOOR_KM; distances to a border are taken in degrees and turned into kilometres at the row's latitude. A row
    whose postal letter contradicts its province stays as it is, and so does one of an unknown area.
    """
    joined = rows.withColumn("__area", scalars.postal_area(F.trim("postal"))).join(areas.withColumnRenamed("area", "__of"), F.col("__area") == F.col("__of"), "left")
    agrees = F.col("__of").isNotNull() & scalars.postal_agrees(F.col("__area"), F.col("province"))
    degrees = geo.distance(F.col("rings"), F.col("lat"), F.col("lon"))
    far = degrees * geo.KM_A_DEGREE > F.greatest(F.lit(POSTAL_FLOOR_KM), F.sqrt(F.col("km2") / F.lit(math.pi)))
    moved = agrees & (F.col("lat").isNull() | F.coalesce(far, F.lit(False)))
    new = {"lat": F.col("mid_lat"), "lon": F.col("mid_lon"), "how": F.lit("FSA_Centroid")}
    marked = joined.withColumn("__moved", moved)
    return marked.select(*[F.when(F.col("__moved"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def publish(df: DataFrame, path: str, check=None) -> str:
    """Writes a table beside the others of ``path`` and makes it the current one; returns where it is.

    The new version goes to a folder of its own; ``check(version)`` may raise, and then the current one stays. A pointer
    row with the next number is appended last, as one file that Spark's committer moves into place. Pointers are never
    removed, so a reader always finds one, and it has the whole old table or the whole new one.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    if check is not None:
        check(spark.read.parquet(f"{path}/{version}"))
    last = pointers(spark, path)
    number = 1 if last is None else last.agg(F.max("number")).first()[0] + 1
    spark.createDataFrame([(number, version)], POINTER).coalesce(1).write.mode("append").parquet(f"{path}/current")
    return f"{path}/{version}"


POINTER = "number long, version string"


def pointers(spark: SparkSession, path: str) -> DataFrame | None:
    """The pointer rows of a published table; None before the first."""
    try:
        return spark.read.schema(POINTER).parquet(f"{path}/current")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that was published last."""
    rows = pointers(spark, path)
    if rows is None:
        raise ValueError(f"nothing has been published at {path}")
    return spark.read.parquet(f"{path}/{rows.agg(F.max_by('version', F.struct('number', 'version'))).first()[0]}")
