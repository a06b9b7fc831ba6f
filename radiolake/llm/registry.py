"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from radiolake.llm import bpe, license_scan, media, minhash, mixing, periodic_runs, quality_classifier, quality_rules, secret_scan, simhash, spelling, token_files, toxicity

MODULES = [quality_rules, bpe, mixing, secret_scan, simhash, token_files, toxicity, quality_classifier, media, license_scan, periodic_runs, minhash, spelling]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
