"""Mixing sources to target weights by repeating documents.

Words are added up by source; the sources' targets give each a repetition rate; a document is emitted floor(rate) times
and once more with the probability of the rest, drawn from a hash of its id and text, so that a rerun emits the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.common import documents, n_words, ranked, staged

#: A target stops at so many times its source's size.
MOST = 3
#: Weights go round by the sources' order.
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: Up to so many sources their rates are broadcast (a few dozen bytes each); beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def source_rates(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """One row for each source (null is one): source, source_size, weight, target, rate.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all words by weight. A target over
    ``MOST`` times its source's size stops there and the excess is shared among the others by weight, until none is
    over. Each round is one aggregation over the sources; the set that stops only grows. A source without words has
    target and rate 0.
    """
    totals = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    placed = staged(ranked(totals, F.col(source).asc_nulls_last(), name="place"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    weighed = placed.select(source, "source_size", weight.cast("long").alias("weight"))
    share, stopped = 0.0, -1
    while True:
        over = F.col("source_size") * MOST < F.col("weight") * F.lit(share)
        got = weighed.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(over, F.col("source_size") * MOST)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weights"),
            F.count_if(over).alias("stopped"),
        ).first()
        if got["stopped"] == stopped or not got["weights"]:
            break
        stopped, share = got["stopped"], (got["all"] - got["held"]) / got["weights"]
    target = F.when(over, (F.col("source_size") * MOST).cast("double")).otherwise(F.col("weight") * F.lit(share))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return weighed.withColumn("target", target).withColumn("rate", rate)


def draw(key: str = "doc_id", text: str = "text"):
    """A number from 0 to 1 for each document, the same in every run: 52 bits of an MD5 of seed, id and text."""
    seeded = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(seeded.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


def with_copies(measured: DataFrame) -> DataFrame:
    """Adds the source's figures and ``copies`` to rows that have ``source``, ``size`` and ``draw``.

    A hot source is one row of the rates' side; where that side is too large to broadcast, the join's large parts can
    be split.
    """
    rates = staged(source_rates(measured.select("source", "size"))).withColumnRenamed("source", "__of")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    whole = F.floor("rate")
    copies = whole + (F.col("draw") < F.col("rate") - whole).cast("long")
    return measured.join(rates, F.col("source").eqNullSafe(F.col("__of"))).drop("__of").withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as many times as its source's rate asks for; same columns.

    A null text has size 0 and null is a source like any other. Rows with equal id and text share their draw. Extra
    columns go along whatever their names; an empty table gives an empty mix.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", n_words(F.col("text")).alias("size"), draw().alias("draw"))
    rates = staged(source_rates(staged(rows.select("source", "size").groupBy("source").agg(F.sum("size").alias("size")))).select(F.col("source").alias("__of"), "rate"))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    whole = F.floor("rate")
    copies = whole + (F.col("draw") < F.col("rate") - whole).cast("long")
    counted = rows.join(rates, F.col("source").eqNullSafe(F.col("__of"))).select("row", copies.cast("int").alias("copies")).where("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    measured = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw().alias("draw")))
    return with_copies(measured).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op3_mixing": op3_mixing}
SQL = {
    "op3_mixing": f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 3.0 / weight, source) AS k FROM s),
p AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  / CAST((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS share FROM o),
f AS (SELECT share FROM p WHERE NOT 3 * source_size < weight * share ORDER BY k LIMIT 1),
r AS (SELECT s.*, CASE WHEN 3 * source_size < weight * share THEN CAST(3 * source_size AS DOUBLE) ELSE weight * share END AS target FROM s, f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM r)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source"""
}
