"""Streams over ``events`` and ``conversations``, run to the end of what is there; place names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import places as names
from radiolake.plans.tables import table
from radiolake.shared import shared_dir
from radiolake.streaming import jobs

QUERIES, SQL = {}, {}


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files; a pattern, as a stream's path must not be a file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def stream_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("uuid"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"),
        F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("last_edited"), F.col("event_id").alias("arrival_seq"), F.col("event_type").alias("mode"),
    )
    return jobs.upserts(changes, shared_dir(spark)).select("uuid", "created_at", "last_edited", "arrival_seq", "mode")


QUERIES["stream_lww"] = stream_lww
SQL["stream_lww"] = """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts) DESC, event_id DESC) AS r, first_value(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS born FROM events)
SELECT user_id AS uuid, epoch_us(born) // 1000 AS created_at, epoch_us(date_trunc('hour', ts)) // 1000 AS last_edited, event_id AS arrival_seq, event_type AS mode FROM f WHERE r = 1"""


def stream_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = stream(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("at"))
    return jobs.presence(beats, shared_dir(spark), 7200).select("client", F.unix_millis("at").alias("at_ms"))


QUERIES["stream_presence"] = stream_presence
SQL["stream_presence"] = """SELECT user_id AS client, epoch_us(max(ts)) // 1000 AS at_ms FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7200 SECOND"""


def stream_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"))
    return jobs.tumbling(rows, shared_dir(spark), "6 hours", "60 days").select(F.unix_seconds("start").alias("bin_start"), "n")


QUERIES["stream_bins"] = stream_bins
SQL["stream_bins"] = "SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS bin_start, count(*) AS n FROM events GROUP BY 1"


def stream_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    return jobs.chat(rows, shared_dir(spark), ["conv_id", "role"], "turn")


QUERIES["stream_chat"] = stream_chat
SQL["stream_chat"] = "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role"

QUERIES["accent_fold"] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.md5(names.strip_accents(F.coalesce("text", F.lit(""))).cast("binary")).alias("plain_md5"))
SQL["accent_fold"] = "SELECT doc_id, md5(strip_accents(coalesce(text, ''))) AS plain_md5 FROM documents"
