"""Entry forms and stations: merging an entry's sources, presence of bands, cached answers, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions import scalars
from radiolake.operators.log import matched


def merged_entry(fields: dict[str, list[Column]]) -> list[Column]:
    """For each field the first of its sources that isn't blank: typed, cross-filled, remembered, looked up, default."""
    return [F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in sources], F.lit("")).alias(name) for name, sources in fields.items()]


def cross_fill(section: Column, state: Column, state_of: dict[str, str], section_of: dict[str, str]) -> tuple[Column, Column]:
    """A state from the section, else a section from the state; both read what was typed."""
    lookup = lambda known, c: F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), c)
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    new_state = F.when(has(section), F.coalesce(lookup(state_of, section), state)).otherwise(state)
    new_section = F.when(~has(section) & has(state), F.coalesce(lookup(section_of, state), section)).otherwise(section)
    return new_section, new_state


def band_conflicts(roster: DataFrame, seconds: int = 61) -> DataFrame:
    """Bands that several clients were heard on within so many seconds of the last heartbeat, and how many."""
    now = roster.agg(F.max("at")).scalar()
    live = roster.where((F.col("band") != "Off-Air") & (F.col("at") >= now - F.make_dt_interval(secs=F.lit(seconds))))
    return live.groupBy("band").agg(F.countDistinct("client").alias("clients")).where("clients > 1")


def in_band_order(roster: DataFrame, bands: list[str], name: str = "place") -> DataFrame:
    """Stations with their rank in the event's order of bands; off the air and unknown bands come last, alike."""
    at = F.array_position(F.array(*map(F.lit, bands)), F.col("band"))
    return roster.withColumn(name, F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(len(bands))).otherwise(at - 1).cast("int"))


def age_bucket(seconds: Column) -> Column:
    """How long ago a station was heard: fresh under 15 s, stale up to 60 s, else old."""
    return F.when(seconds < 15, "fresh").when(seconds <= 60, "stale").otherwise("old")


def status_counts(cache: DataFrame) -> DataFrame:
    """Cached answers by status; each of the three is there even without any."""
    known = cache.sparkSession.createDataFrame([(s,) for s in ("ok", "not_found", "error")], "status string")
    counted = cache.groupBy("status").agg(F.count("*").alias("n"))
    return known.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cache_put(cache: DataFrame, answers: DataFrame, key: str = "call") -> DataFrame:
    """The cache after new answers: of each key the last one fetched, the new one on a tie, with its end."""
    both = cache.select(*answers.columns).withColumn("__new", F.lit(0)).unionByName(answers.withColumn("__new", F.lit(1)))
    others = [c for c in answers.columns if c != key]
    kept = both.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("fetched_ms", "__new")).alias("s")).select(key, "s.*")
    return kept.withColumn("expires_ms", scalars.expires(F.col("fetched_ms"), F.col("status")))


def cache_live(cache: DataFrame, now_ms: int) -> DataFrame:
    """Answers that haven't ended; the others are what a purge removes."""
    return cache.where(F.col("expires_ms") > now_ms)


def one_event(rows: DataFrame, cached: str, column: str = "event") -> DataFrame:
    """Rows of another event than the one a replica holds: if there are any, the logs must not be mixed."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(cached))).groupBy(column).agg(F.count("*").alias("n"))


#: What a prompt of an export is unless it says otherwise.
PROMPT = {"required": False, "max_length": 20}


def unanswered(prompts: list[dict], answers: DataFrame, by: str) -> DataFrame:
    """What keeps each export (``by``) from being written: ``name`` of a prompt and ``problem``, required and blank, or too long.

    Every export has the same prompts, with the defaults of PROMPT where they say nothing; ``answers`` has ``by``, ``name`` and ``answer``. An answer is
    trimmed; one that isn't there is blank. A null ``by`` is an export like any other.
    """
    told = [PROMPT | p for p in prompts]
    asked = F.array(*[F.struct(F.lit(p["name"]).alias("name"), F.lit(p["required"]).alias("required"), F.lit(p["max_length"]).alias("most")) for p in told])
    every = answers.select(by).distinct().select(by, F.explode(asked).alias("p")).select(by, "p.*")
    given = answers.groupBy(by, "name").agg(F.max(F.trim("answer")).alias("answer"))
    answer = F.coalesce("answer", F.lit(""))
    problem = F.when(F.col("required") & (answer == ""), "missing").when(F.length(answer) > F.col("most"), "too long")
    return matched(every, given, [by, "name"], "left").withColumn("problem", problem).where("problem IS NOT NULL").select(by, "name", "problem")


def corrected(rows: DataFrame, key: str, column: str, corrections: list[tuple]) -> DataFrame:
    """Applies (key, old, new) corrections: ``state`` tells applied, already or stale; other rows have null."""
    value, state = F.col(column), F.lit(None).cast("string")
    for k, old, new in corrections:
        here = F.col(key) == k
        state = F.when(here & (F.col(column) == old), "applied").when(here & (F.col(column) == new), "already").when(here, "stale").otherwise(state)
        value = F.when(here & (F.col(column) == old), F.lit(new)).otherwise(value)
    return rows.select(*[value.alias(c) if c == column else F.col(c) for c in rows.columns], state.alias("state"))


def call_index(sources: dict[str, DataFrame]) -> DataFrame:
    """One row for each callsign of any source, with each source's largest value and the number of sources.

    Every source has ``call`` and ``value``; a callsign whose value is null still belongs to the source.
    """
    rows = None
    for name, df in sources.items():
        part = df.select("call", *[F.struct(F.lit(1).alias("has"), F.col("value").alias("value")).alias(n) if n == name else F.lit(None).cast(f"struct<has:int,value:{dict(df.dtypes)['value']}>").alias(n) for n in sources])
        rows = part if rows is None else rows.unionByName(part)
    folded = rows.groupBy("call").agg(*[F.max(f"{n}.value").alias(n) for n in sources], *[F.max(f"{n}.has").alias(f"__{n}") for n in sources])
    return folded.select("call", *sources, sum((F.coalesce(f"__{n}", F.lit(0)) for n in sources), F.lit(0)).cast("int").alias("source_count"))


def import_report(rows: DataFrame, required: list[str]) -> DataFrame:
    """What an import would do: all rows, those that can't be used, and how many miss each required value."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = F.lit(False)
    for c in required:
        bad = bad | blank(F.col(c))
    return rows.agg(F.count("*").alias("total"), F.count_if(bad).alias("bad"), *[F.count_if(blank(F.col(c))).alias(f"missing_{c}") for c in required])
