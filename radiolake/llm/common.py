"""What the operators share: reading documents, native word splitting, and the library's shared-folder tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.shared import ranked, shared_dir, staged

__all__ = ["BLANKS", "documents", "let", "n_words", "ranked", "shared_dir", "staged", "words"]

#: ASCII white space, the separator of words in most contracts, as a Java character class.
BLANKS = "[\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The needed columns of the documents, so that the scan reads no others."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{BLANKS}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words ``text`` has, by deleting: every word and every run of blanks becomes one character."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANKS}+", " "))
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(squeezed == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)
