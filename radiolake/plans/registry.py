"""All registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from radiolake.plans import activity, building, builds, contact_log, enrichment, exporting, files, flows, geometry, imports, location, parsing, places, records, rules, upkeep

MODULES = [activity, contact_log, places, enrichment, building, flows, upkeep, exporting, location, imports, records, rules, files, parsing, geometry, builds]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
