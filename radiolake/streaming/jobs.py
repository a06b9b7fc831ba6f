"""Streaming jobs over change logs, with keyed state.

What a job knows of each key is a value in the state store: a batch reads and writes the keys of its rows and nothing
else, and the store's checkpoint survives a restart. What changes is appended to a log in a folder given by the caller, a folder
for each batch, so a batch that runs again replaces what it wrote. The result is the last version of each key. A long log is
settled when a job starts: its last versions become a snapshot, and what the snapshot holds is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Folders of batches beyond which a log is settled when its job starts.
SETTLE = 32
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def existing(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The Parquet table at a path; an empty one if nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Versions:
    """A log of rows' versions in folders by batch, and the last version of each key."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys
        self.schema = schema

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the folders that are complete, smallest first."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        marks = system.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS"))
        return sorted(int(m.getPath().getParent().getName()) for m in marks)

    def _remove(self, kind: str, numbers: list[int]) -> None:
        for n in numbers:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def append(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch/{batch}")

    def read(self) -> DataFrame:
        """The last version of each key: what the newest snapshot and the batches after it hold."""
        snapshot = max(self._numbers("snapshot"), default=-1)
        later = [n for n in self._numbers("batch") if n > snapshot]
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/batch/{n}").withColumn("__batch", F.lit(n)) for n in later]
        if snapshot >= 0:
            parts.append(self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshot/{snapshot}").withColumn("__batch", F.lit(snapshot)))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), "__batch").alias("s")).select("s.*")

    def settle(self, most: int = SETTLE) -> None:
        """Makes a snapshot of a log of more than ``most`` batches and removes what it holds; a stop in between costs nothing."""
        batches = self._numbers("batch")
        if len(batches) > most:
            self.read().write.mode("overwrite").parquet(f"{self.path}/snapshot/{batches[-1]}")
        snapshots = self._numbers("snapshot")
        if snapshots:
            self._remove("batch", [n for n in batches if n <= snapshots[-1]])
            self._remove("snapshot", snapshots[:-1])


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for a while; a query keeps those that it started with."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(rows: DataFrame, path: str, keys: list[str], mode: str = "update") -> Versions:
    """Runs a stream of versions to the end of what is there and logs them; returns the log."""
    versions = Versions(rows.sparkSession, f"{path}/log", rows.schema, keys)
    versions.settle()
    with configured(rows.sparkSession, STORE):
        write = rows.writeStream.outputMode(mode).foreachBatch(lambda batch, number: versions.append(batch, number))
        query = write.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return versions


class KeyedFold(StatefulProcessor):
    """Keeps a row for each key: ``keep`` of the row so far (None at first) and each new one. Rows that change are put out."""

    def __init__(self, schema: T.StructType, keep: Callable[[Any, Any], tuple]):
        self.schema, self.keep = schema, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = now = self.row.get()
        for row in rows:
            now = tuple(row) if now is None else self.keep(now, tuple(row))
        if now != before:
            self.row.update(tuple(now))
            yield Row(**dict(zip(self.schema.names, now, strict=True)))

    def close(self) -> None:
        pass


def folding(stream: DataFrame, path: str, keys: list[str], keep: Callable[[Any, Any], tuple]) -> DataFrame:
    """The rows that :class:`KeyedFold` keeps of a stream, one for each key; null keys are one key."""
    kept = stream.groupBy(*keys).transformWithState(KeyedFold(stream.schema, keep), stream.schema, "Update", "None")
    return run(kept, path, keys).read()


def upserts(changes: DataFrame, path: str) -> DataFrame:
    """Current state of a stream of changes, last write wins; see :func:`radiolake.operators.log.fold`.

    The order of arrival over batches doesn't matter: an older edit that comes late loses, a tie goes to the larger
    ``arrival_seq``. The fold keeps the earliest ``created_at`` under the smallest arrival, so that column's arrival
    is carried as ``born_seq``.
    """
    marked = changes.withColumn("born_seq", F.col("arrival_seq"))
    at = {c: i for i, c in enumerate(marked.columns)}
    edited, arrived, born, created = (at[c] for c in ("last_edited", "arrival_seq", "born_seq", "created_at"))

    def keep(old: tuple, new: tuple) -> tuple:
        later = lambda r: tuple((r[i] is not None, r[i]) for i in (edited, arrived))
        first = min(old, new, key=lambda r: tuple((r[i] is None, r[i]) for i in (born, created)))
        won = list(max(old, new, key=later))
        won[born], won[created] = first[born], first[created]
        return tuple(won)

    return folding(marked, path, ["uuid"], keep).drop("born_seq")


class Heard(StatefulProcessor):
    """The last heartbeat of a client, and a timer at its time: it fires when the watermark, that many seconds behind, has passed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp, ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        newest = max(((r["ms"], r["at"]) for r in rows))
        before = self.last.get()
        if before is None or newest[0] > before[1]:
            if before is not None:
                self.handle.deleteTimer(before[1])
            self.last.update((newest[1], newest[0]))
            self.handle.registerTimer(newest[0])
            yield Row(client=key[0], at=newest[1], present=True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at = self.last.get()[0]
        self.last.clear()
        yield Row(client=key[0], at=at, present=False)

    def close(self) -> None:
        pass


def presence(heartbeats: DataFrame, path: str, seconds: int = 120) -> DataFrame:
    """Clients heard within so many seconds of the last heartbeat of all.

    Each client's state is its last heartbeat, with a timer that evicts it once the stream's time is more than that many seconds
    ahead; heartbeats that come later than that change nothing. Heartbeats without a time are left out. Times count in milliseconds.
    """
    timed = heartbeats.where("at IS NOT NULL").withWatermark("at", f"{1000 * seconds + 1} milliseconds").withColumn("ms", F.unix_millis("at"))
    schema = T.StructType([heartbeats.schema["client"], heartbeats.schema["at"], T.StructField("present", T.BooleanType())])
    heard = timed.groupBy("client").transformWithState(Heard(), schema, "Update", "EventTime")
    return run(heard, path, ["client"]).read().where("present").drop("present")


def chat(messages: DataFrame, path: str, key: list[str], arrival: str) -> DataFrame:
    """The history: of messages with one key the first to arrive. What was cleared at some arrival stays away."""
    at = messages.columns.index(arrival)
    history = folding(messages, path, key, lambda old, new: min(old, new, key=lambda r: (r[at] is None, r[at])))
    cleared = existing(messages.sparkSession, f"{path}/cleared", "upto long").agg(F.max("upto")).first()[0]
    return history if cleared is None else history.where(F.col(arrival) > cleared)


def clear_chat(spark: SparkSession, path: str, upto: int) -> None:
    """Clears the history up to an arrival, itself included: a marker, so that messages read again don't come back."""
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").parquet(f"{path}/cleared")


def tumbling(contacts: DataFrame, path: str, width: str, lateness: str = "1 hour") -> DataFrame:
    """Contacts in windows of fixed width, kept up to date: a window's last count replaces the ones before it.

    State older than the lateness is dropped; late contacts of closed windows are left out by the watermark.
    """
    counted = contacts.withWatermark("at", lateness).groupBy(F.window("at", width)).agg(F.count("*").alias("n"))
    rows = counted.select(F.col("window.start").alias("start"), "n")
    return run(rows, path, ["start"]).read()


def change_gated(spark: SparkSession, path: str, latest: int, write: Callable[[], None]) -> bool:
    """Calls ``write`` only if the latest change differs from the one that was written last; tells if it did.

    What was written last is kept at the path, so the gate holds over restarts.
    """
    last = existing(spark, f"{path}/marker", "number long, latest long").agg(F.max(F.struct("number", "latest")).alias("m")).select("m.*").first()
    if last["number"] is not None and last["latest"] == latest:
        return False
    write()
    spark.createDataFrame([((last["number"] or 0) + 1, latest)], "number long, latest long").coalesce(1).write.mode("append").parquet(f"{path}/marker")
    return True
