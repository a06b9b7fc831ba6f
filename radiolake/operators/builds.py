"""Builds of several phases that go on where they stopped, and the Canadian licensees' and the callsigns' builds."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import places, scalars
from radiolake.operators import etl, location, search, spatial

LEDGER = "number long, key string, phase string, folder string"


@dataclass(frozen=True)
class Phase:
    """A step of a build: the table it makes of the earlier phases' tables that it ``reads``.

    ``version`` names the state of whatever else goes into it, such as a file's date; another version is another phase.
    """

    name: str
    make: Callable[..., DataFrame]
    reads: tuple[str, ...] = ()
    version: str = ""


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def keys(phases: list[Phase]) -> dict[str, str]:
    """For each phase a digest of its name, its version and all that goes into it."""
    found: dict[str, str] = {}
    for phase in phases:
        if phase.name in found:
            raise ValueError(f"two phases are called {phase.name}")
        unknown = [r for r in phase.reads if r not in found]
        if unknown:
            raise ValueError(f"{phase.name} reads what no earlier phase makes: {', '.join(unknown)}")
        found[phase.name] = _digest(phase.name, phase.version, [found[r] for r in phase.reads])
    return found


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What a build has finished, in order; empty before its first phase."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/finished")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _finish(spark: SparkSession, path: str, key: str, phase: str, folder: str) -> None:
    number = (ledger(spark, path).agg(F.max("number")).first()[0] or 0) + 1
    spark.createDataFrame([(number, key, phase, folder)], LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/finished")


def run(spark: SparkSession, path: str, phases: list[Phase], check: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Makes what is missing of the phases' tables and publishes the last one's; returns the published table.

    A finished phase is a row of a ledger beside its table, which is appended only when the table is whole. So a build that
    failed, or lost its driver, goes on with the phase it was in, and one with a newer input begins at the first phase that
    reads it. ``check(table)`` may raise: then what was published before stays, and the next run checks again. One build
    at a time writes to a path; readers see the old table or the new one.
    """
    want = keys(phases)
    done = {r["key"]: r["folder"] for r in ledger(spark, path).where(F.col("key").isin(list(want.values()))).collect()}
    tables: dict[str, DataFrame] = {}
    for phase in phases:
        key = want[phase.name]
        if key not in done:
            done[key] = f"{phase.name}-{uuid.uuid4().hex}"
            phase.make(*[tables[r] for r in phase.reads]).write.parquet(f"{path}/phases/{done[key]}")
            _finish(spark, path, key, phase.name, done[key])
        tables[phase.name] = spark.read.parquet(f"{path}/phases/{done[key]}")
    last = phases[-1].name
    published = ledger(spark, path).where("phase = 'publish'").agg(F.max_by("key", "number")).first()[0]
    if published != _digest("publish", want[last]):
        etl.publish(tables[last], f"{path}/published", check)
        _finish(spark, path, _digest("publish", want[last]), "publish", "")
    return etl.current(spark, f"{path}/published")


def whole(key: str, least: int) -> Callable[[DataFrame], None]:
    """A check that a table has at least so many rows, and each key once and not null."""

    def check(table: DataFrame) -> None:
        n, keyed, distinct = table.agg(F.count("*"), F.count(key), F.countDistinct(key)).first()
        if n < least or keyed < n or distinct < n:
            raise ValueError(f"{n} rows of at least {least}, {distinct} different keys")

    return check


# --- licensees of a country without coordinates of its own ----------------------------------------------------------


def street_key(street: Column, city: Column, province: Column) -> Column:
    """The key of a street address; null without a street."""
    return F.when(F.trim(street) != "", etl.address_key(street, city, province))


def town_key(city: Column, province: Column) -> Column:
    """The key of a town in any of its spellings; null without a town."""
    return F.when(F.trim(city) != "", etl.address_key(places.strip_accents(city), province))


def place_unplaced(rows: DataFrame, cache: DataFrame, key: Column, ident: str) -> DataFrame:
    """Rows without a place take the cache's for their key: ``lat``, ``lon`` and ``how``. A null key has none.

    ``cache`` has ``key``, ``matched``, ``fetched_at``, ``lat``, ``lon``, ``how``; of repeated answers the last one fetched counts.
    Rows that need nothing get keys of their own, so they don't meet in one task.
    """
    answer = F.max_by(F.struct("lat", "lon", "how"), F.struct("fetched_at", "lat", "lon", "how")).alias("__answer")
    known = cache.where("matched AND key IS NOT NULL").groupBy(F.col("key").alias("__key")).agg(answer)
    asked = F.when(F.col("lat").isNull(), key)
    salted = rows.withColumn("__key", F.coalesce(asked, F.concat(F.lit("\u0000"), F.xxhash64(ident).cast("string"))))
    joined = salted.join(known, "__key", "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__answer.{c}")).alias(c) if c in ("lat", "lon", "how") else F.col(c) for c in rows.columns])


def province_placed(rows: DataFrame, divisions: DataFrame) -> DataFrame:
    """Rows still without a place take the inner point of their province's largest division, as ``Province_Centroid``."""
    points = divisions.select("province", F.struct(F.col("mid_lat").alias("lat"), F.col("mid_lon").alias("lon"), F.lit("Province_Centroid").alias("how")).alias("point"), "area", F.col("position").alias("ident"))
    asked = rows.withColumns({"province": F.upper(F.trim("state")), "__place": F.when(F.col("lat").isNotNull(), F.struct("lat", "lon", "how"))})
    placed = etl.largest_member(asked, points, "province", "__place")
    return placed.select(*[F.col(f"__place.{c}").alias(c) if c in ("lat", "lon", "how") else F.col(c) for c in rows.columns])


def canadian(licensees: DataFrame, streets: DataFrame, towns: DataFrame, areas: DataFrame, divisions: DataFrame, counties: DataFrame, versions: dict[str, str], skip: tuple[str, ...] = ()) -> list[Phase]:
    """The phases of the Canadian licensees' table; those named in ``skip`` leave the table as it is.

    ``licensees`` has ``usi`` (unique), ``street``, ``city``, ``state``, ``postal``; ``streets`` and ``towns`` are caches for
    ``place_unplaced``; ``areas`` are postal areas for ``etl.postal_checked``; ``divisions`` has ``province``, ``county``, ``position``,
    ``rings``, ``area``, ``mid_lat``, ``mid_lon``; ``counties`` is for ``location.with_section``. A place is looked for by street, then by town;
    then the postal area places what has none or contradicts it, and the province is the last resort. Such a place tells
    no county, so these rows get none. ``versions`` may name the state of each of the inputs.
    """
    place = {"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "how": F.lit(None).cast("string")}

    def county(rows: DataFrame) -> DataFrame:
        precise = rows.where("lat IS NOT NULL AND how <> 'Province_Centroid'")
        return rows.join(spatial.nearest_part(precise, divisions, "usi", "county", "position"), "usi", "left")

    entity = {"dxcc_entity": F.lit("Canada"), "dxcc_id": F.lit(1), "continent": F.lit("NA")}
    steps = [
        ("licensees", "licensees", lambda: licensees.withColumns(place)),
        ("street", "streets", lambda t: place_unplaced(t, streets, street_key(F.col("street"), F.col("city"), F.col("state")), "usi")),
        ("town", "towns", lambda t: place_unplaced(t, towns, town_key(F.col("city"), F.col("state")), "usi")),
        ("postal", "areas", lambda t: etl.postal_checked(t.withColumn("province", scalars.text(F.col("state"))), areas).drop("province")),
        ("province", "divisions", lambda t: province_placed(t, divisions)),
        ("county", "divisions", county),
        ("section", "counties", lambda t: location.with_section(t.withColumns(entity), counties)),
    ]
    without = {"county": lambda t: t.withColumn("county", F.lit(None).cast("string")), "section": lambda t: t.withColumns(entity | {"section": F.lit(None).cast("string")})}
    phases, before = [], ()
    for name, given, make in steps:
        skipped = name in skip and name != "licensees"
        phases.append(Phase(name, without.get(name, lambda t: t) if skipped else make, before, "skipped" if skipped else versions.get(given, "")))
        before = (name,)
    return phases


# --- the table of callsigns -----------------------------------------------------------------------------------------

# What the sources tell of a callsign, and which of it says by being there that the callsign is in a source.
CALL_COLUMNS = {"fd_last_year": "long", "wfd_last_year": "long", "pota_hunter_qsos": "long", "pota_activations": "long", "lotw_last_upload": "string", "clublog": "long", "clublog_last_qso": "string", "scp": "long"}
CALL_SOURCES = ("fd_last_year", "wfd_last_year", "pota_hunter_qsos", "pota_activations", "lotw_last_upload", "clublog", "scp")
CALL_MARKS = ("clublog", "scp")


def merge_calls(sources: list[DataFrame], seen: str, before: DataFrame | None = None) -> DataFrame:
    """One row for each callsign of the sources and of the table ``before``; none is ever lost.

    A source has ``call`` and some of CALL_COLUMNS. All values only go forward, so a source that isn't given leaves what
    it told; ``first_seen`` stays, ``last_seen`` is this run's ``seen`` for the callsigns of its sources, and
    ``source_count`` is counted anew. All meet in one aggregation, whatever the number of sources.
    """
    known = {"first_seen": "string", "last_seen": "string"}
    marked = [s.withColumns({"first_seen": F.lit(seen), "last_seen": F.lit(seen)}) for s in sources] + ([] if before is None else [before])
    if not marked:
        raise ValueError("neither sources nor a table before")
    typed = [df.where("call IS NOT NULL").select("call", *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (CALL_COLUMNS | known).items()]) for df in marked]
    rows = reduce(DataFrame.unionByName, typed)
    merged = rows.groupBy("call").agg(*[F.max(c).alias(c) for c in CALL_COLUMNS], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    merged = merged.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in CALL_MARKS})
    inside = [F.when(F.col(c) > 0 if c in CALL_MARKS else F.col(c).isNotNull(), 1).otherwise(0) for c in CALL_SOURCES]
    return merged.withColumn("source_count", reduce(lambda a, b: a + b, inside))


def call_index(spark: SparkSession, path: str, sources: dict[str, tuple[DataFrame, str]], seen: str) -> DataFrame:
    """Takes sources (a table and its version each) into the published table of callsigns and its suffix index; the table.

    Each source is a phase, so a run that fails goes on without reading the finished ones again. The index at
    ``{path}/suffixes`` is for ``search.in_index``: its first run writes it, later ones add the new callsigns' suffixes. It holds a
    callsign only after the table does.
    """
    last = ledger(spark, path).where("phase = 'publish'").agg(F.max("number")).first()[0]
    before = None if last is None else etl.current(spark, f"{path}/published")
    read = [Phase(f"source-{name}", lambda df=df: df, version=version) for name, (df, version) in sources.items()]
    merge = Phase("calls", lambda *tables: merge_calls(list(tables), seen, before), tuple(p.name for p in read), f"{seen} after {last}")
    calls = run(spark, path, [*read, merge], whole("call", 1))
    if ledger(spark, path).where("phase = 'index'").isEmpty():
        search.write_index(calls, f"{path}/suffixes")
        _finish(spark, path, "", "index", "suffixes")
    else:
        search.extend_index(calls, f"{path}/suffixes")
    return calls
