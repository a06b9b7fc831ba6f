"""Bulk callsign enrichment: a chain of sources, and operator overrides in a fixed order of precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions import scalars


def chain(calls: DataFrame, sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Each call's record from the first source that has it, with ``source``; calls that none has keep null.

    Calls are looked up once each, in one join for each source. ``error`` is the first source's that failed on a call (its
    column ``error``, where it has one), and only if none resolved it. Of several rows of a source with one key those
    without an error come first, then the smallest in the order of their fields; a source's null keys are left out.
    """
    fields = [c for c in sources[0][1].columns if c not in (key, "error")]
    out, hits, errors = calls.select(key).distinct(), [], []
    for place, (name, source) in enumerate(sources):
        error = F.col("error") if "error" in source.columns else F.lit(None).cast("string")
        one = F.min(F.struct(error.isNotNull().alias("__failed"), *fields, error.alias("__error"))).alias(f"__{place}")
        out = out.join(source.where(F.col(key).isNotNull()).groupBy(key).agg(one), key, "left")
        found = F.col(f"__{place}")
        hits.append(F.when(~found["__failed"], F.struct(*[found[c].alias(c) for c in fields], F.lit(name).alias("source"))))
        errors.append(found["__error"])
    hit = F.coalesce(*hits)
    return out.select(key, hit.alias("__hit"), F.coalesce(*errors).alias("__error")).select(key, *[F.col(f"__hit.{c}").alias(c) for c in [*fields, "source"]], F.when(F.col("__hit").isNull(), F.col("__error")).alias("error"))


def override(record: dict[str, Column], branches: list[tuple[Column, dict[str, Column]]]) -> list[Column]:
    """A record's fields after the first branch whose condition holds; a branch that doesn't name a field leaves it.

    Conditions are tried in order and only one branch is applied. A condition that is null doesn't hold.
    """
    out = []
    for name, value in record.items():
        chosen = None
        for condition, fields in branches:
            given = fields.get(name, value)
            chosen = F.when(F.coalesce(condition, F.lit(False)), given) if chosen is None else chosen.when(F.coalesce(condition, F.lit(False)), given)
        out.append((value if chosen is None else chosen.otherwise(value)).alias(name))
    return out


def single_valued(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have one value only, with it."""
    return rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__most")).where(F.col(value) == F.col("__most")).drop("__most")


def by_key(calls: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each call's row of a table, as often as it is asked for; calls that the table hasn't keep null."""
    return calls.join(table, key, "left")


def autofill(record: dict[str, Column]) -> list[Column]:
    """What a record gives to an entry form, null for what it doesn't give.

    A person's first name in title case (nobody else's); state and continent only if the form would accept them; zones
    and distance as text, a distance of nothing included.
    """
    first = F.split_part(F.trim(record["name"]), F.lit(" "), F.lit(1))
    name = F.when(record["license_type"] == "person", F.nullif(F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 1000))), F.lit("")))
    accepted = [*scalars.STATES.values(), *scalars.PROVINCES, "DX"]
    continent = F.upper(record["continent"])
    given = {f: F.nullif(record[f], F.lit("")) for f in ("country", "gridsquare", "county")} | {f: record[f].cast("string") for f in ("distance", "itu_zone", "cq_zone")}
    given |= {"name": name, "state": F.when(record["state"].isin(*accepted), record["state"]), "continent": F.when(continent.isin(*scalars.CONTINENTS), continent)}
    return [value.alias(f) for f, value in given.items()]
