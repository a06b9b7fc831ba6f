"""A corpus pipeline: quality rules, near-duplicate removal, secret redaction, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result to the shared folder and reads it back as the next one's documents, so a lost
executor costs the tasks it ran, not a stage. Null texts have no words and go in the first stage; null ids and sources,
repeated rows, extra columns and empty tables are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from radiolake.llm import bpe, mixing, quality_rules, secret_scan, simhash
from radiolake.llm.common import staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, from hosts that pass."""
    return quality_rules.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles)."""
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked in their texts."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for: left out, once or repeated."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of the ids and of the decoded bytes, one row for each row of the mix."""
    return bpe.digest(bpe.encode(docs))


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("source mixing", mix_sources),
    ("byte-level bpe", tokenise),
]

#: Neither XXH64 fingerprints nor BPE merges can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
