"""Streams with keyed state: many batches, restarts, rows read twice, the edge of presence, and logs that are settled."""

from datetime import datetime, timedelta

from radiolake.operators import log
from radiolake.streaming import jobs

CHANGE = "uuid string, created_at long, last_edited long, arrival_seq long, mode string"
T0 = datetime(2024, 6, 1, 12)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def source(spark, tmp_path, schema):
    put = lambda name, batch: spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{name}"))
    return put, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_changes_in_batches_with_restarts_and_rows_read_twice(spark, tmp_path):
    put, stream = source(spark, tmp_path, CHANGE)
    batches = [
        [("a", 1, 5, 1, "first"), ("b", 1, 1, 2, "x"), (None, 7, 1, 3, "none")],
        [("a", 2, 5, 4, "tie"), ("a", 3, 4, 5, "old")],
        [("b", 4, 9, 6, "new"), ("c", 1, None, 7, "undated"), ("c", 2, 0, 8, "dated")],
        [("a", 1, 5, 1, "first"), ("b", 4, 9, 6, "new")],  # a pull that begins with what the last one ended with
    ]
    out = f"file://{tmp_path}/out"
    for i, batch in enumerate(batches):
        put(f"{i:02d}", batch)
        if i % 2:
            got = jobs.upserts(stream(), out)  # the query starts again, and goes on
    want = rows(log.fold(spark.createDataFrame(sum(batches, []), CHANGE)).select("uuid", "created_at", "mode"))
    assert rows(got.select("uuid", "created_at", "mode")) == want and len(want) == 4
    assert rows(jobs.upserts(stream(), out).select("uuid", "created_at", "mode")) == want  # nothing new
    # the last batch changed nothing, so it wrote nothing, however large the state is
    assert spark.read.schema(CHANGE).parquet(f"{out}/log/batch/3").count() == 0


def test_presence_ends_at_its_edge(spark, tmp_path):
    put, stream = source(spark, tmp_path, "client string, at timestamp")
    at = lambda s: T0 + timedelta(milliseconds=1000 * s)
    put("00", [("a", at(0)), ("b", at(100)), ("c", at(99.999)), ("d", at(50)), (None, at(150)), ("e", None)])
    put("01", [("d", at(210)), ("b", at(40)), ("f", at(220))])
    out = f"file://{tmp_path}/out"
    got = jobs.presence(stream(), out, 120)
    assert rows(got.select("client")) == [("b",), ("d",), ("f",), (None,)]  # c is a millisecond too old, b isn't
    put("02", [("a", at(221)), ("late", at(90))])
    assert rows(jobs.presence(stream(), out, 120).select("client")) == [("a",), ("d",), ("f",), (None,)]


def test_logs_are_settled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs.Versions.settle, "__defaults__", (2,))
    put, stream = source(spark, tmp_path, CHANGE)
    out = f"file://{tmp_path}/out"
    for i in range(5):
        put(f"{i:02d}", [("a", i, i, i, f"m{i}"), (f"k{i}", 0, 0, 100 + i, "x")])
    first = rows(jobs.upserts(stream(), out))
    put("05", [("a", 9, 9, 9, "last")])
    got = jobs.upserts(stream(), out)
    assert sorted(p.name for p in (tmp_path / "out/log/batch").iterdir()) == ["5"] and [p.name for p in (tmp_path / "out/log/snapshot").iterdir()] == ["4"]
    assert len(first) == 6 and rows(got.where("uuid <> 'a'")) == [r for r in first if r[0] != "a"] and got.where("uuid = 'a'").first()["mode"] == "last"
